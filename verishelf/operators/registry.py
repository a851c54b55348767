"""The entity registry: two-tier lookup, write-back as a keyed merge, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verishelf.functions.vocab import RegistryConfig
from verishelf.operators import textmodel
from verishelf.sources.tables import cut


def lookup(rows: DataFrame, entities: DataFrame, idf: DataFrame, config: RegistryConfig | None = None) -> DataFrame:
    """row_uid, hit, tier, entity_id, similarity for each row.

    rows: row_uid, gtin_id, fp_id, variant_terms; entities: entity_id, block_ids (all block keys
    it is found under), variant_terms. Tier 0 is an equi-join on the identifier. Rows that miss
    it, and have variant terms, are compared within their fingerprint block by cosine; the best
    entity at or over the threshold wins, ties by the smaller id. Both probes are equi-joins, so
    nothing is compared outside a block.
    """
    config = config or RegistryConfig()
    keys = entities.select("entity_id", "variant_terms", F.explode("block_ids").alias("block"))
    exact = rows.join(keys.select(F.col("block").alias("gtin_id"), F.col("entity_id").alias("e0")), "gtin_id", "left").groupBy("row_uid").agg(F.min("e0").alias("e0"))
    missed = exact.where("e0 is null").select("row_uid").join(rows.where(F.size("variant_terms") > 0), "row_uid")
    near = missed.select("row_uid", F.col("fp_id").alias("block"), F.array_join("variant_terms", " ").alias("q")).join(keys.where(F.size("variant_terms") > 0).select("block", "entity_id", F.array_join("variant_terms", " ").alias("e")), "block")
    texts = near.select("q", "e").distinct()  # similarity is of texts: each pair of texts once
    scored = textmodel.pair_cosines(texts, "q", "e", idf)
    best = (
        near.join(scored, ["q", "e"])
        .where(F.round("cosine", 9) >= config.tau_ann)
        .groupBy("row_uid")
        .agg(F.min_by(F.struct("entity_id", "cosine"), F.struct(-F.round("cosine", 9), F.col("entity_id"))).alias("b"))
        .select("row_uid", F.col("b.entity_id").alias("e1"), F.col("b.cosine").alias("s1"))
    )
    return exact.join(best, "row_uid", "left").select(
        "row_uid",
        (F.col("e0").isNotNull() | F.col("e1").isNotNull()).alias("hit"),
        F.when(F.col("e0").isNotNull(), "tier0_exact").when(F.col("e1").isNotNull(), "tier1_ann").alias("tier"),
        F.coalesce("e0", "e1").alias("entity_id"),
        F.when(F.col("e0").isNull(), F.col("s1")).alias("similarity"),
    )


def upsert(entities: DataFrame, confirmed: DataFrame) -> DataFrame:
    """The registry after a batch of confirmed rows.

    entities: entity_id, brand, module, resolved_url, characteristics (map), confidence,
    member_row_uids, created_at, updated_at. confirmed: the same without created_at and
    members, plus row_uid, row_index and sourced (whether a model gave the characteristics).
    Rows of one entity are merged in row order: the last one's url, module that isn't null and
    sourced characteristics win, members are united. What is stored stays where a batch has null.
    """
    late = lambda c, cond=None: F.max_by(c, F.when(F.col(c).isNotNull() if cond is None else cond, F.col("row_index")))
    batch = confirmed.groupBy("entity_id").agg(
        late("brand").alias("n_brand"),
        late("module").alias("n_module"),
        late("resolved_url").alias("n_url"),
        late("confidence").alias("n_confidence"),
        late("characteristics", F.col("sourced")).alias("n_characteristics"),
        F.collect_set("row_uid").alias("n_members"),
        F.max("updated_at").alias("n_at"),
    )
    none = F.array().cast("array<string>")
    return entities.join(batch, "entity_id", "full_outer").select(
        "entity_id",
        F.coalesce("n_brand", "brand").alias("brand"),
        F.coalesce("n_module", "module").alias("module"),
        F.coalesce("n_url", "resolved_url").alias("resolved_url"),
        F.coalesce("n_characteristics", "characteristics").alias("characteristics"),
        F.coalesce("n_confidence", "confidence").alias("confidence"),
        F.array_sort(F.array_union(F.coalesce("member_row_uids", none), F.coalesce("n_members", none))).alias("member_row_uids"),
        F.coalesce("created_at", "n_at").alias("created_at"),
        F.coalesce("n_at", "updated_at").alias("updated_at"),
    )


def refresh(entities: DataFrame, hits: DataFrame) -> DataFrame:
    """Entities completed by hits: a module is filled, never replaced; sourced characteristics and
    members are added. changed says whether that made a difference.

    hits: entity_id, row_uid, row_index, module, characteristics, sourced.
    """
    batch = hits.groupBy("entity_id").agg(
        F.min_by("module", F.when(F.col("module").isNotNull(), F.col("row_index"))).alias("n_module"),
        F.max_by("characteristics", F.when(F.col("sourced"), F.col("row_index"))).alias("n_characteristics"),
        F.collect_set("row_uid").alias("n_members"),
    )
    joined = entities.join(batch, "entity_id", "left")
    members = F.array_sort(F.array_union("member_row_uids", F.coalesce("n_members", F.array().cast("array<string>"))))
    new = joined.withColumns({"_module": F.coalesce("module", "n_module"), "_characteristics": F.coalesce("n_characteristics", "characteristics"), "_members": members})
    flat = lambda c: F.to_json(F.array_sort(F.map_entries(c)))
    changed = ~(F.col("_module").eqNullSafe(F.col("module")) & flat("_characteristics").eqNullSafe(flat("characteristics")) & F.col("_members").eqNullSafe(F.col("member_row_uids")))
    kept = [c for c in entities.columns if c not in ("module", "characteristics", "member_row_uids")]
    return new.select(*kept, F.col("_module").alias("module"), F.col("_characteristics").alias("characteristics"), F.col("_members").alias("member_row_uids"), changed.alias("changed"))


def audit(entities: DataFrame, run_id: str) -> DataFrame:
    """One append-only record for each entity written."""
    return entities.select("entity_id", F.col("member_row_uids").alias("row_uids"), "confidence", F.lit("tier2_retrieval").alias("tier"), F.lit(run_id).alias("run_id"), F.col("updated_at").alias("written_at"))


def check_members(entities: DataFrame) -> DataFrame:
    """Entities with members that aren't row ids (sheet:index)."""
    return entities.where(F.exists("member_row_uids", lambda m: ~F.contains(m, F.lit(":"))))


def summary(entities: DataFrame) -> DataFrame:
    return entities.agg(F.count("*").alias("entities"), F.count("module").alias("with_module"), F.count_if(F.size(F.map_keys("characteristics")) > 0).alias("with_characteristics"))


def recent(entities: DataFrame, n: int = 12) -> DataFrame:
    return entities.orderBy(F.desc("updated_at"), "entity_id").limit(n)


#: Edges that one task links up by itself.
SHARD = 250_000


def _roots(a: pa.ChunkedArray, b: pa.ChunkedArray) -> pa.RecordBatch:
    """node, root of a shard of edges: the smallest node that it reaches in the shard."""
    codes = pa.chunked_array([*a.chunks, *b.chunks], pa.string()).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(codes.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    ends = place[codes.indices.to_numpy()].reshape(2, -1)
    root = np.arange(len(order))
    while True:
        low, high = root[ends].min(axis=0), root[ends].max(axis=0)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    names = codes.dictionary.take(order)
    return pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], names=["node", "root"])


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD):
            part = batch.slice(at, SHARD)
            if held and n + part.num_rows > 2 * SHARD:
                t = pa.Table.from_batches(held)
                yield _roots(t["a"], t["b"])
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        t = pa.Table.from_batches(held)
        yield _roots(t["a"], t["b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): connected components of an undirected edge list (a, b) of strings.

    The component is its smallest node. Shards of edges, dealt by ranges of a, are linked up by one task each;
    what is left is a graph of their roots, of those that share a node, for which labels fall along the edges.
    Self-edges give a component of one.
    """
    few = lambda df: F.broadcast(df) if df.count() <= 100_000 else df
    own = cut(edges.select("a", "b").where("a is not null and b is not null"))
    stars = cut(own.repartitionByRange(max(1, math.ceil(own.count() / SHARD)), "a").mapInArrow(_link_shards, "node string, root string"))
    nodes = cut(stars.groupBy("node").agg(F.min("root").alias("root"), (F.min("root") != F.max("root")).alias("split")))
    split = nodes.where("split").select("node", F.col("root").alias("b"))
    links = cut(stars.join(few(split), "node").where("root <> b").select(F.col("root").alias("a"), "b").distinct())
    if not links.take(1):
        return nodes.select("node", F.col("root").alias("component"))
    joined = _fall(links, rounds).withColumnRenamed("node", "root")
    return nodes.join(few(joined), "root", "left").select("node", F.coalesce("component", "root").alias("component"))


def _fall(edges: DataFrame, rounds: int) -> DataFrame:
    """components by rounds: labels fall along the edges and jump to their label's label, so the rounds grow with the
    log of a component's diameter; each is checkpointed."""
    both = cut(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).withColumnRenamed("a", "node"))
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("l").alias("m")).withColumnRenamed("a", "node")
        low = labels.join(seen, "node").select("node", F.least("l", "m").alias("n"), "l")
        jump = low.join(low.select(F.col("node").alias("n"), F.col("n").alias("j")), "n")
        after = cut(jump.select("node", F.least("n", "j").alias("l"), (F.least("n", "j") < F.col("l")).alias("moved")))
        labels = after.select("node", "l")
        if not after.where("moved").take(1):
            return labels.withColumnRenamed("l", "component")
    raise RuntimeError("components did not settle")


def members(nodes: DataFrame) -> DataFrame:
    """component, members (sorted). A component's members are one array: bound their number first."""
    return nodes.groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("members"))


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
