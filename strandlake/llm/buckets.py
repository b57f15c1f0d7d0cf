"""Links within buckets of candidates, such as those of one band or one posting list, without all pairs of a large bucket.

A bucket's members are compared by `near`; of a group of members that hang together only spanning links are made. `twice` must
hold for any two members that are both near a third one: for a metric, within twice the distance of `near`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare

#: Members of a bucket in one task, twice so many at most; larger buckets are first compared with CENTRES of their members.
BLOCK = 512
CENTRES = 4


@dataclass(frozen=True)
class Likeness:
    """read: what is compared, from a member's body; near, twice: of two of these."""

    read: Callable[[Any], Any]
    near: Callable[[Any, Any], bool]
    twice: Callable[[Any, Any], bool]


def spanning_links(ids: list[int], bodies: list, like: Likeness) -> list[tuple[int, int]]:
    """Verified links that connect all members of a bucket which any verified links would connect.

    Each member is compared with the members of each component so far until one is near. Members that come first should be the
    likely centres: then a group of near copies costs one comparison for each of its members.
    """
    read = [like.read(b) for b in bodies]
    links: list[tuple[int, int]] = []
    groups: list[list[int]] = []
    for z, own in enumerate(read):
        near, far = [z], []
        for group in groups:
            for m in group:
                if like.near(own, read[m]):
                    links.append((ids[z], ids[m]))
                    near = group + near
                    break
            else:
                far.append(group)
        groups = [*far, near] if len(near) == 1 else [near, *far]
    return links


def _grouped(df: DataFrame, key: list[str], rest: list[str], order: list, handle: Callable[[list[tuple]], Any], schema: str) -> DataFrame:
    """handle(rows of one key, in order) gives the result's rows; a key's rows must fit a task's memory."""
    prepare(df.sparkSession)
    dealt = df.repartition(*key).sortWithinPartitions(*key, *order).select(*key, *rest)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.list_(pa.int64()) if "array" in x else pa.string() if "string" in x else pa.int64() for x in schema.split(", ")]

    def give(held: list[tuple]) -> pa.RecordBatch:
        found = list(handle(held))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[: len(key)] != now:
                    if held:
                        out.append(give(held))
                        if len(out) > 1000:
                            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else out[0]
                            out = []
                    now, held = row[: len(key)], []
                held.append(row)
        if held:
            out.append(give(held))
        if sum(x.num_rows for x in out):
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return dealt.mapInArrow(run, schema)


def _spanned(members: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): spanning links of buckets; members: (k, blocks, n, h, body). A bucket of several blocks is dealt out in pairs of
    blocks, so each two of its members meet and no task holds more than two blocks of it."""
    mine = F.expr("cast(pmod(xxhash64(h), blocks) as int)")
    pairs = F.transform(F.sequence(F.lit(0), F.expr("cast(blocks - 1 as int)")), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    dealt = members.select("k", "n", "h", "body", F.inline(pairs))
    return _grouped(dealt, ["k", "i", "j"], ["h", "body"], [F.desc("n"), "h"], lambda rows: spanning_links([r[3] for r in rows], [r[4] for r in rows], like), "a long, b long")


def _pivoted(large: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Links of large buckets over their centres, and the members left to compare with one another; large: (k, size, n, h, body).

    All members are compared with CENTRES frequent ones. Those near a centre, its ball, hang together already. Whatever is near a
    member of the ball is within `twice` of the centre: such members outside of the ball, the shell, are compared with the ball's
    members until one is near. Members in no ball are left for _spanned. So nothing is lost, and a group of near copies costs one
    comparison a member.
    """
    block, kind = BLOCK, dict(large.dtypes)["body"]
    kind = "long" if kind == "bigint" else kind
    blocks = F.expr(f"cast((size - 1) div {block} + 1 as int)")
    top = large.groupBy("k", F.pmod("h", F.lit(CENTRES)).alias("s")).agg(F.max(F.struct("n", "h", "body", "size")).alias("c")).select("k", "c.*")
    dealt = large.select("k", F.expr(f"pmod(xxhash64(h), (size - 1) div {block} + 1)").cast("int").alias("i"), F.lit(1).alias("role"), "n", "h", "body")
    dealt = dealt.unionByName(top.select("k", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), F.lit(0).alias("role"), "n", "h", "body"))

    def judge(rows: list[tuple]) -> Iterator[tuple]:
        centres = [(r[4], like.read(r[5])) for r in rows if r[2] == 0]
        for k, _, role, n, h, body in rows:
            if role:
                own = like.read(body)
                ball = [c for c, x in centres if like.near(own, x)]
                yield k, n, h, body, ball, [c for c, x in centres if c not in ball and like.twice(own, x)]

    schema = f"k long, n long, h long, body {kind}, ball array<long>, shell array<long>"
    judged, _ = materialize(_grouped(dealt, ["k", "i"], ["role", "n", "h", "body"], ["role", "h"], judge, schema), "pivots")
    direct = judged.select(F.col("h").alias("a"), F.explode("ball").alias("b")).where("a <> b")
    shell = judged.select("k", F.explode("shell").alias("c"), "h", "body")
    ball = judged.select("k", F.explode("ball").alias("c"), "h", "body")
    of = lambda df, name: df.groupBy("k", "c").agg(F.expr(f"cast((count(*) - 1) div {block} + 1 as int)").alias(name))
    sizes = of(ball, "u").join(of(shell, "v"), ["k", "c"])
    place = lambda n: F.expr(f"cast(pmod(xxhash64(h), {n}) as int)")
    each = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    meet = ball.join(sizes, ["k", "c"]).select("k", "c", place("u").alias("i"), each("v").alias("j"), F.lit(0).alias("role"), "h", "body")
    meet = meet.unionByName(shell.join(sizes, ["k", "c"]).select("k", "c", each("u").alias("i"), place("v").alias("j"), F.lit(1).alias("role"), "h", "body"))

    def across(rows: list[tuple]) -> Iterator[tuple]:
        inner = [(r[5], like.read(r[6])) for r in rows if r[4] == 0]
        for r in rows:
            if r[4]:
                own = like.read(r[6])
                if (hit := next((h for h, x in inner if like.near(own, x)), None)) is not None:
                    yield r[5], hit

    links = direct.unionByName(_grouped(meet, ["k", "c", "i", "j"], ["role", "h", "body"], ["role", "h"], across, "a long, b long"))
    alone = judged.where(F.size("ball") == 0)
    counts = alone.groupBy("k").agg(F.expr(f"(count(*) - 1) div {block} + 1").alias("blocks"))
    return links, alone.join(counts, "k").select("k", "blocks", "n", "h", "body")


def bucket_links(members: DataFrame, like: Likeness) -> DataFrame:
    """(a, b): verified links that connect what any verified links of a bucket would.

    members: (k: bucket, size: its members, n: how often a member stands, h: a member's id, body: what `like` reads). No members:
    no links. A member may be in several buckets; ids may repeat in a bucket.
    """
    small = members.where(f"size <= {BLOCK}").select("k", F.lit(1).cast("long").alias("blocks"), "n", "h", "body")
    links, left = _pivoted(members.where(f"size > {BLOCK}"), like)
    return links.unionByName(_spanned(small.unionByName(left), like))
