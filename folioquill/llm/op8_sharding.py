"""Sharding by balanced label propagation over documents that share a text.

Every document starts in a hashed shard, those of a group too large for one in as many as it needs. In each round a Spark join brings every linked document
the shard in which most of its group lies, and as many groups move as the shards' quotas of linked
documents allow, until none can. Groups that still lie in several shards are dealt whole by the room
that is left. A last pass levels the counts: documents without links are moved first and groups too
large for a shard next, so that few links are cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import gapless_rank, materialize, tidy

SHARDS, ROUNDS = 8, 4
NODE = ["doc_id", "size", "text_crc32", "grp", "members", "shard"]


def propagate(nodes: DataFrame, n_rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of quota-bound moves over (doc_id, grp, members, shard); grp null has no links. Returns the same columns.

    A shard's quota of linked documents is its share of all rows: the others give way when counts are levelled.
    Groups larger than a share stay where they are and use up quota.
    """
    share = n_rows // shards
    small = F.coalesce(F.col("members") <= share, F.lit(False))
    big = {r["shard"]: r["count"] for r in nodes.where(~small & F.col("grp").isNotNull()).groupBy("shard").count().collect()}  # at most ``shards`` rows
    quotas = {t: max(0, share - big.get(t, 0)) for t in range(shards)}
    per = lambda c, value: reduce(lambda x, t: x.when(F.col(c) == t, F.lit(value[t])), range(shards), F.when(F.lit(False), F.lit(0.0)))
    for k in range(rounds):
        parts = nodes.where("grp is not null").groupBy("grp", "shard").agg(F.count("*").alias("n"))
        best = parts.groupBy("grp").agg(F.max(F.struct("n", F.pmod(F.xxhash64("grp", "shard"), F.lit(97)).alias("h"), "shard")).alias("m"), F.count("*").alias("spread"))
        best = materialize(best.select("grp", F.col("m.shard").alias("to"), "spread"), "votes")
        wish = materialize(nodes.join(best, "grp", "left").withColumn("to", F.coalesce("to", "shard")), "wishes")
        flow = {(r["shard"], r["to"]): r["count"] for r in wish.where(small).groupBy("shard", "to").count().collect()}  # shards squared
        held = {s: sum(n for (a, b), n in flow.items() if a == b == s) for s in range(shards)}
        into = {t: sum(n for (a, b), n in flow.items() if b == t != a) for t in range(shards)}
        if k and not any(into.values()):
            break
        if k + 1 == rounds:  # groups that are still split are dealt whole by the room that is left
            split = F.col("spread") > 1
            rest = {r["shard"]: r["count"] for r in wish.where(small & (F.col("spread") == 1)).groupBy("shard").count().collect()}
            room = [max(0, quotas[t] - rest.get(t, 0)) for t in range(shards)]
            total, cuts = sum(room) or 1, []
            for r in room:
                cuts.append((cuts[-1] if cuts else 0.0) + r / total)
            u = F.pmod(F.xxhash64("grp", F.lit(-1)), F.lit(1 << 20)) / float(1 << 20)
            dealt = reduce(lambda x, t: x.when(u < cuts[t], F.lit(t)), range(shards - 1), F.when(F.lit(False), F.lit(0))).otherwise(F.lit(shards - 1))
            to = F.when(small & split, dealt).otherwise(F.col("shard"))
        else:  # whole groups move or wait together, by a hash of group and round
            quota = {t: min(1.0, max(0, quotas[t] - held[t]) / into[t]) if into[t] else 0.0 for t in range(shards)}
            luck = F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(1 << 20)) / float(1 << 20)
            to = F.when(small & (luck < per("to", quota)), F.col("to")).otherwise(F.col("shard"))
        nodes = materialize(wish.withColumn("shard", F.when(F.col("grp").isNull(), F.col("shard")).otherwise(to).cast("int")).select(*NODE), "shards")
    return nodes


@tidy
def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard all documents; the shards' row counts differ by at most one.

    Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null: the law is not
    'key'). Null text has size 1, checksum 0 and no links; equal texts are linked. Ties between
    shards go by a hash of group and shard. An empty table gives no rows. Rows of one doc_id are
    documents of their own that share a name; a null doc_id is one more name. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64(F.sha2(text, 256))).alias("h"),
    )
    base = materialize(base, "texts")
    n_rows = base.count()
    many = materialize(base.where("h is not null").groupBy("h").agg(F.count("*").alias("members")).where("members > 1").select("h", F.col("h").alias("grp"), "members"), "groups")
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards))
    need = F.least(F.ceil(F.col("members") / F.lit(max(1.0, 0.9 * (n_rows // shards)))), F.lit(shards))  # shards that a large group fills
    spread = F.pmod(F.xxhash64("grp") + F.pmod(F.xxhash64("doc_id"), need), F.lit(shards))
    start = F.when(F.col("members") > n_rows // shards, spread).otherwise(start)
    nodes = materialize(base.join(many, "h", "left").withColumn("shard", start.cast("int")).select(*NODE), "shards")
    nodes = propagate(nodes, n_rows, shards, rounds)

    # level: what lies beyond a shard's share, unlinked documents first, fills the shards below theirs
    share = {s: n_rows // shards + (s < n_rows % shards) for s in range(shards)}
    have = {r["shard"]: r["count"] for r in nodes.groupBy("shard").count().collect()}  # at most `shards` rows
    per = lambda c, value: reduce(lambda x, s: x.when(F.col(c) == s, F.lit(value[s])), range(shards), F.when(F.lit(False), F.lit(0)))
    tier = F.when(F.col("grp").isNull(), 2).when(F.col("members") > n_rows // shards, 1).otherwise(0)
    ranked = materialize(gapless_rank(nodes, ["shard"], "doc_id", n_rows, "slot", tier).drop("members"), "ranked", keep=True)
    spare, at = {}, 0
    for s in range(shards):  # running start of each overfull shard's surplus
        spare[s], at = at, at + max(0, have.get(s, 0) - share[s])
    start_of, gap = [], 0
    for s in range(shards):
        need = max(0, share[s] - have.get(s, 0))
        if need:
            start_of.append((gap, gap + need, s))
        gap += need
    over = F.col("slot") >= per("shard", share)
    k = F.col("slot") - per("shard", share) + per("shard", spare)
    moved = reduce(lambda x, g: x.when(k < g[1], F.lit(g[2])), start_of, F.when(F.lit(False), F.lit(0)))
    slot = reduce(lambda x, g: x.when(k < g[1], k - g[0] + have.get(g[2], 0)), start_of, F.when(F.lit(False), F.lit(0)))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(over, moved).otherwise(F.col("shard")).cast("int").alias("shard"),
        F.when(over, slot).otherwise(F.col("slot")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
