"""Prefix trie of conversations by prefix doubling: no prefix is ever spelled out, and no conversation meets in one task.

Turns are named by dense numbers; a block of 2^k turns at a place divisible by 2^k is named by the pair of its halves'
names, one join round for each k. A prefix of d turns is the list of at most log2(d) + 1 block names that d's binary
digits give, one join on (conversation, place) for each digit. Nodes are groups of equal lists. Sums over subtrees go up
the trie by doubled steps: after round k a node holds the sum over its descendants less than 2^(k+1) below it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, numbered, scratch, table

#: Ids that one string of a node's digest holds at most; a node's strings are hashed one after the other.
IDS = 4096
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, turn, bytes) of each row, pos from 0 in the order of turn, and (conv_id, n) of each conversation.

    turn is a SHA-256 of role and text (null: empty), bytes the UTF-8 length of the text. Null turns come first; ties go
    by the digest, so that repeated rows stay, each a turn. Rows without conv_id belong to no conversation and are left
    out. Positions are places in one range-partitioned sort less the conversation's first: a conversation with a third
    of all rows is spread over tasks like any other. Texts are not shuffled.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("__turn"), turn.alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    rows, _ = numbered(rows, "turns", "__g", (F.col("conv_id"), F.col("__turn").asc_nulls_first(), F.col("turn")))
    convs = materialize(rows.groupBy("conv_id").agg(F.min("__g").alias("first"), F.count("*").alias("n")), "conversations")
    placed = rows.join(convs, "conv_id").select("conv_id", (F.col("__g") - F.col("first")).alias("pos"), "turn", "bytes")
    return materialize(placed, "placed-turns"), convs.select("conv_id", "n")


def rebuilt(turns: DataFrame, convs: DataFrame, every: int = 5, lengths: int = 9) -> tuple[DataFrame, DataFrame]:
    """turns and convs with each conversation c's first h turns replaced by those of c - c % every, h = crc32(c) % lengths.

    All turns of the other if it has fewer, none if it isn't there; c keeps its own turns after its first h.
    """
    own = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % lengths})
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = own.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0).cast("long"))))
    own = materialize(own.select("conv_id", "n", "base", "h", "taken"), "rebuilt")
    kept = turns.join(own, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn", "bytes")
    shared = turns.where((F.col("pos") < lengths - 1) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    shared = shared.join(own, "base").where("pos < h").select("conv_id", "pos", "turn", "bytes")
    return kept.unionByName(shared), own.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("n"))


def _named(rows: DataFrame, keys: list[str], before: int, tag: str) -> tuple[DataFrame, int]:
    """(conv_id, i, name): keys replaced by dense names from before on, and the number after the last."""
    names, count = numbered(rows.select(*keys).distinct(), f"{tag}-names", "name")
    out = rows.join(names.withColumn("name", F.col("name") + before), keys).select("conv_id", "i", "name")
    return materialize(out, tag), before + count


def named_blocks(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each k up to log2(longest), (conv_id, i, name) of every whole block of turns i 2^k to (i + 1) 2^k - 1; blocks of
    any conversations have one name if and only if they hold the same turns."""
    level, known = _named(turns.select("conv_id", F.col("pos").alias("i"), "turn"), ["turn"], 0, "blocks-0")
    levels = [level]
    while 2 ** len(levels) <= longest:
        half = lambda odd: F.max(F.when(F.col("i") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv_id", F.floor(F.col("i") / 2).alias("i")).agg(half(0).alias("left"), half(1).alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
        level, known = _named(pairs, ["left", "right"], known, f"blocks-{len(levels)}")
        levels.append(level)
    return levels


def named_prefixes(convs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv_id, d, key) for each d from 0 to the conversation's length: key is the list of names of the blocks that d's
    binary digits cut the first d turns into, from the largest. Equal keys are equal sequences of turns."""
    out = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.array().cast("array<bigint>").alias("key"))
    for k in range(len(levels) - 1, -1, -1):
        block = levels[k].where("i % 2 = 0").select("conv_id", (F.col("i") * 2**k).alias("d"), "name")
        same, longer = F.struct("d", "key"), F.struct((F.col("d") + 2**k).alias("d"), F.array_append("key", F.col("name")).alias("key"))
        both = F.when(F.col("name").isNull(), F.array(same)).otherwise(F.array(same, longer))
        out = out.join(block, ["conv_id", "d"], "left").select("conv_id", F.explode(both).alias("x")).select("conv_id", "x.*")
    return materialize(out, "prefixes")


def _hashed(batches):
    """SHA-256 over the strings of one node after the other; rows come sorted by (node, d, chunk)."""
    at, digest = None, None
    for batch in batches:
        done = []
        for node, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if at != (node, d):
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (node, d), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["node", "d", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], ["node", "d", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, d, ends_sha256) from (node, d, conv_id): SHA-256 of the node's conv_ids, ascending, joined by commas.

    Ids are sorted over all nodes by range and joined in strings of IDS at most, in parallel; a node's strings then pass
    through one hash in order, as SHA-256 must, without ever being held together.
    """
    placed, _ = numbered(ends, "ends", "g", ("node", "d", "conv_id"))
    chunks = placed.groupBy("node", "d", F.floor(F.col("g") / IDS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("node", "d").sortWithinPartitions("node", "d", "chunk").mapInArrow(_hashed, "node long, d long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first d turns of the conversations in convs (conv_id, n turns), d from 0.

    conv_id is the smallest member (a conversation that starts with the sequence), depth d, parent_conv_id the parent's
    conv_id (null for the root), n_convs the members, n_children the children, n_leaves the childless nodes of the
    subtree, saved_tokens the sum over the subtree of (n_convs - 1) times the bytes of the last turn, ends_sha256 the
    SHA-256 of the members that end here; turn is the last turn's digest. turns: conv_id, pos from 0 without gaps,
    turn, bytes. No conversations: no nodes, not even a root. conv_id must be unique in convs.
    """
    spark = turns.sparkSession
    with scratch(spark) as kept:
        return kept(_trie(materialize(turns, "trie-turns"), materialize(convs, "trie-convs")), "trie")


def _trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    root, longest = convs.agg(F.min("conv_id"), F.coalesce(F.max("n"), F.lit(0))).first()
    prefixes = named_prefixes(convs, named_blocks(turns, longest))
    nodes = materialize(prefixes.groupBy("key").agg(F.min("conv_id").alias("node"), F.min("d").alias("d"), F.count("*").alias("n_convs")), "nodes")
    # the node of each conversation at each depth; the root's is known, so that only groups of equal turns are hot keys
    below = prefixes.where("d > 0").join(nodes.select("key", "node"), "key").select("conv_id", "d", "node")
    top = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(root).cast("long").alias("node"))
    paths = materialize(below.unionByName(top), "paths")

    parents = paths.select(F.col("conv_id").alias("node"), (F.col("d") + 1).alias("d"), F.col("node").alias("parent"))
    last = turns.select(F.col("conv_id").alias("node"), (F.col("pos") + 1).alias("d"), "turn", "bytes")
    own = nodes.select("node", "d", "n_convs").join(parents, ["node", "d"], "left").join(last, ["node", "d"], "left")
    children = own.where("d > 0").groupBy(F.col("parent").alias("node"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    own = own.join(children, ["node", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    own = materialize(own, "own")

    sums = own.select("node", "d", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0).cast("long"))).alias("saved"))
    step = 1
    while step <= longest:
        up = paths.where(F.col("d") + step <= longest).select(F.col("conv_id").alias("node"), (F.col("d") + step).alias("d"), F.col("node").alias("above"))
        here, there = F.struct("node", "d", "leaves", "saved"), F.struct(F.col("above").alias("node"), (F.col("d") - step).alias("d"), "leaves", "saved")
        both = F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))
        sums = sums.join(up, ["node", "d"], "left").select(F.explode(both).alias("x")).groupBy("x.node", "x.d").agg(F.sum("x.leaves").alias("leaves"), F.sum("x.saved").alias("saved"))
        step *= 2

    ends = paths.join(convs.select("conv_id", F.col("n").alias("d")), ["conv_id", "d"]).select("node", "d", "conv_id")
    return own.join(sums, ["node", "d"]).join(ends_digests(ends), ["node", "d"], "left").select(
        F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "turn",
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    with scratch(spark) as kept:
        turns, convs = rebuilt(*ordered_turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
        return kept(prefix_trie(turns, convs).drop("turn"), "op11")


OP11_SQL = """
WITH rows_ AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM rows_),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, t.key, t.text, 0 AS part, t.pos FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, t.key, t.text, 1, t.pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h),
placed AS (
  SELECT conv_id, key, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM rebuilt),
prefixes AS (
  SELECT conv_id, d, sha256(string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY d)) AS prefix, strlen(text) AS bytes FROM placed
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
lengths AS (SELECT conv_id, max(d) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
  SELECT prefix, d, min(conv_id) AS node, count(*) AS n_convs, max(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes JOIN lengths USING (conv_id) GROUP BY prefix, d),
parents AS (
  SELECT x.prefix, x.d, y.prefix AS parent FROM nodes x JOIN prefixes y ON y.conv_id = x.node AND y.d = x.d - 1),
kids AS (SELECT parent AS prefix, count(*) AS n FROM parents GROUP BY parent),
full_ AS (SELECT x.*, coalesce(k.n, 0) AS n_children FROM nodes x LEFT JOIN kids k USING (prefix)),
subtree AS (
  SELECT a.prefix, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM full_ x JOIN prefixes a ON a.conv_id = x.node AND a.d <= x.d GROUP BY a.prefix)
SELECT x.node AS conv_id, CAST(x.d AS BIGINT) AS depth, q.node AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends_sha256
FROM full_ x JOIN subtree s USING (prefix) LEFT JOIN parents p USING (prefix) LEFT JOIN nodes q ON q.prefix = p.parent
"""
