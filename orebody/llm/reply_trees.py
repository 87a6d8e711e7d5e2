r"""Chat formatting of reply trees: every root-to-leaf path found, the best of each tree chosen, each chosen one written as one conversation.

Messages name the message they answer. Joining the table of ancestors with itself doubles its reach each round, so that a thread of n messages
takes log2(n) rounds; sums of scores are carried along, and each leaf knows its root, its depth and its path's score before any path
is listed. Chosen paths are then listed by the same tables, from the farthest reach to the nearest: each round doubles what is listed, and all
rounds together write no more rows than twice what the paths hold. A message with many answers makes a hot key on the side that may be split.

The template writes a message as `### role: text </turn>` and a line feed. In roles and texts `\` becomes `\\`, `##` becomes `#\#` and `</turn>`
becomes `<\/turn>`, in roles also `: ` becomes `:\ `, so that none of its marks can stand in them; a `\` before any character is read as that
character. The loss mask is a list of spans of code points of the whole text.

Edge cases: null roles and texts are empty, null scores 0. Answers to a message that isn't there are roots. Equal rows are one message; of different
rows with one id the one with the highest score counts (ties: least parent, role, text, with nulls first). Rows without an id are leaves, as nobody
can name them. Ties among paths go to the least leaf. A circle of answers is an error, found once the reach is beyond the number of messages.
An empty table gives no rows; columns of other names are ignored. A conversation is one value and so has to fit one row; its messages come together
in blocks first, so that the last task of a long conversation gets a row for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.common import materialize

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
MODEL = "assistant"
BLOCK = 64
SALTS = 32


def escaped(c: Column) -> Column:
    """A text in which neither `###` nor `</turn>` stands."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def escaped_role(c: Column) -> Column:
    return F.replace(escaped(c), F.lit(BETWEEN), F.lit(":\\ "))


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def replies(messages: DataFrame, key: str = "id", parent: str = "parent", score: str | None = "score", role: str = "role", text: str = "text", label: str | None = None) -> DataFrame:
    """One row per message: node, up (the node it answers), score, role, text, label. Nodes are strings made of the ids."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = messages.select(
        F.col(key).cast("string").alias("k"), F.col(parent).cast("string").alias("p"), (F.lit(0.0) if score is None else F.coalesce(F.col(score).cast("double"), F.lit(0.0))).alias("score"),
        value(role).alias("role"), value(text).alias("text"), (F.lit(None) if label is None else F.col(label)).alias("label"),
    )
    named = rows.filter("k is not null").groupBy("k").agg(F.min_by(F.struct("p", "score", "role", "text", "label"), F.struct(-F.col("score"), F.col("p"), F.col("role"), F.col("text"))).alias("m"))
    bare = rows.filter("k is null").distinct()
    digest = F.sha2(F.to_json(F.struct("p", "score", "role", "text", F.col("label").cast("string")), {"ignoreNullFields": "false"}), 256)
    made = named.select(F.concat(F.lit("i"), "k").alias("node"), F.concat(F.lit("i"), F.col("m.p")).alias("up"), "m.score", "m.role", "m.text", "m.label")
    return made.union(bare.select(F.concat(F.lit("h"), digest), F.concat(F.lit("i"), "p"), "score", "role", "text", "label"))


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From node, up and score: tables of (node, anc) whose k-th has the 2^k-th ancestor of those that have one; and for each node its root, n (the
    messages from the root to it) and the sum of their scores."""
    total = nodes.count()
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    state = nodes.select("node", "up", "score").join(known, "up", "left").select("node", F.when(F.col("known"), F.col("up")).alias("anc"), F.lit(1).cast("long").alias("n"), "score")
    state = materialize(state.select("node", "anc", F.when(F.col("anc").isNull(), F.col("node")).alias("root"), "n", "score"), "reply-state")
    tables: list[DataFrame] = []
    while not (going := state.filter("anc is not null")).isEmpty():
        if 1 << len(tables) > total:
            raise ValueError("messages answer each other in a circle")
        tables.append(going.select("node", "anc"))
        # the sums over `n` messages from a node up are met by those from its ancestor up
        above = state.select(F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("root").alias("top"), F.col("n").alias("more"), F.col("score").alias("gain"))
        step = going.join(above, "anc").select("node", F.col("next").alias("anc"), F.col("top").alias("root"), (F.col("n") + F.col("more")).alias("n"), (F.col("score") + F.col("gain")).alias("score"))
        state = materialize(state.filter("anc is null").unionByName(step), "reply-state")
    return tables, state.drop("anc")


def chosen_leaves(nodes: DataFrame, ended: DataFrame, branches: int) -> DataFrame:
    """The leaves of the best `branches` paths of each tree: leaf, root, n, score (the mean of the path's messages), rank (from 1)."""
    leaves = ended.withColumnRenamed("node", "leaf").join(nodes.select(F.col("up").alias("leaf")).distinct(), "leaf", "left_anti").withColumn("score", F.col("score") / F.col("n"))
    order = (F.col("score").desc(), "leaf")
    salted = leaves.withColumn("_salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("root", "_salt").orderBy(*order))).filter(F.col("_r") <= branches)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy(*order)))  # branches * SALTS rows a tree at most
    return ranked.filter(F.col("rank") <= branches).select("leaf", "root", "n", "score", "rank")


def paths(nodes: DataFrame, branches: int = 1) -> tuple[DataFrame, DataFrame]:
    """The best `branches` root-to-leaf paths of each tree (see `chosen_leaves`), and the messages on them: leaf, place (0 at the root), node."""
    tables, ended = ancestors(nodes)
    leaves = materialize(chosen_leaves(nodes, ended, branches), "reply-leaves")
    listed = leaves.select("leaf", F.col("leaf").alias("node"), (F.col("n") - 1).alias("place"))
    for k in range(len(tables) - 1, -1, -1):
        listed = materialize(listed.unionByName(listed.join(tables[k], "node").select("leaf", F.col("anc").alias("node"), (F.col("place") - (1 << k)).alias("place"))), "reply-paths")
    return leaves, listed


def conversations(nodes: DataFrame, branches: int = 1, model: str = MODEL, block: int = BLOCK) -> DataFrame:
    """Each chosen path as one conversation: label (of its leaf), root, leaf, rank, score, n_turns, formatted, loss (array of start and end).

    Only the model's texts are under the loss mask, without the template's marks.
    """
    nodes = materialize(nodes, "reply-nodes")  # read in every round; ids without texts but for the last join
    leaves, listed = paths(nodes, branches)
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(BETWEEN))
    body = escaped(F.col("text"))
    size = lambda c: F.char_length(c).cast("long")
    piece = F.concat(head, body, F.lit(CLOSE))
    turn = F.struct("place", piece.alias("piece"), size(head).alias("start"), (size(head) + size(body)).alias("end"), size(piece).alias("length"), (F.col("role") == model).alias("own"))
    blocks = listed.join(nodes.select("node", "role", "text"), "node").select("leaf", F.floor(F.col("place") / block).alias("block"), turn.alias("t"))
    blocks = blocks.groupBy("leaf", "block").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # `block` turns at most
    spans = F.aggregate(
        "ts", F.struct(F.lit(0).cast("long").alias("length"), F.array().cast("array<struct<start:long,end:long>>").alias("loss")),
        lambda a, t: F.struct(
            (a["length"] + t["length"]).alias("length"),
            F.when(t["own"], F.concat(a["loss"], F.array(F.struct((a["length"] + t["start"]).alias("start"), (a["length"] + t["end"]).alias("end"))))).otherwise(a["loss"]).alias("loss"),
        ),
    )
    written = blocks.select("leaf", "block", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("piece"), spans.alias("s"))
    before = F.coalesce(F.sum("s.length").over(Window.partitionBy("leaf").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = written.withColumn("at", before).select("leaf", F.struct("block", "piece", F.transform("s.loss", lambda x: F.struct((x["start"] + F.col("at")).alias("start"), (x["end"] + F.col("at")).alias("end"))).alias("loss")).alias("b"))
    whole = moved.groupBy("leaf").agg(F.array_sort(F.collect_list("b")).alias("bs"))
    whole = whole.select("leaf", F.array_join(F.transform("bs", lambda b: b["piece"]), "").alias("formatted"), F.flatten(F.transform("bs", lambda b: b["loss"])).alias("loss"))
    labels = nodes.select(F.col("node").alias("leaf"), "label")
    return leaves.join(labels, "leaf").join(whole, "leaf").select("label", "root", "leaf", "rank", "score", F.col("n").alias("n_turns"), "formatted", "loss")


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text, as they were before escaping."""
    pieces = F.split(formatted, CLOSE)  # nowhere else does the mark stand
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    rest = F.transform(pieces, lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    roles = F.transform(rest, lambda p: F.struct(F.substring_index(p, BETWEEN, 1).alias("role"), p.alias("p")))
    return F.transform(roles, lambda r: F.struct(unescaped(r["role"]).alias("role"), unescaped(F.substring(r["p"], F.char_length(r["role"]) + len(BETWEEN) + 1, F.length(r["p"]))).alias("text")))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The text under a loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")


def threads(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as reply trees: each row answers the one before it in its conversation (ties: by role, then text)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(turn, role, text))  # a conversation must fit one row in the end
    own = lambda at: F.concat(F.lit("i"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("|"), at.cast("string"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    numbered = rows.select(key, role, text, place.alias("_place"))
    return numbered.select(
        own(F.col("_place")).alias("node"), F.when(F.col("_place") > 1, own(F.col("_place") - 1)).alias("up"), F.lit(0.0).alias("score"), value(role).alias("role"), value(text).alias("text"), F.col(key).alias("label"),
    )


#: A conversation that holds the template's marks.
MARKED = (-7, ("user", "assistant"), r"\### Assistant: </turn> ok")


def op11_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and a marked one, formatted; digests of the turns and of the text under the loss mask, both read from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(MARKED[0], i, r, MARKED[2]) for i, r in enumerate(MARKED[1])], "conv_id long, turn long, role string, text string")
    made = conversations(threads(rows.unionByName(marked)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = made.select(F.col("label").alias("conv_id"), parsed(F.col("formatted")).alias("turns"), under_mask(F.col("formatted"), F.col("loss")).alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escaped(c: str) -> str:
    return rf"replace(replace(replace({c}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"


OP11_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role AS r, text AS t FROM conversations
  UNION ALL SELECT {MARKED[0]}, 0, '{MARKED[1][0]}', '{MARKED[2]}' UNION ALL SELECT {MARKED[0]}, 1, '{MARKED[1][1]}', '{MARKED[2]}'
), plain AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS i, coalesce(r, '') AS r, coalesce(t, '') AS t FROM turns)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (WHERE r = '{MODEL}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE r = '{MODEL}'), '')) AS loss_sha256,
  sum({len(OPEN) + len(BETWEEN) + len(CLOSE)} + length(replace({_sql_escaped('r')}, '{BETWEEN}', ':\ ')) + length({_sql_escaped('t')}))::BIGINT AS formatted_chars
FROM plain GROUP BY conv_id
"""
