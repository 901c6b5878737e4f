r"""Chat formatting: conversations as training windows under a token budget.

Only DataFrame operations. Prefix sums of the turns' tokens choose turn-aligned spans:
with a budget B, a system turn of s tokens, up to H tokens of history and a largest turn
of t tokens in the conversation, a window takes the turns whose last token falls into
the same stretch of B - s - H - t tokens (1 at least). A window holds, in order, the system
turn (if it is the first turn), whole turns of the window before within H tokens, and its own
turns. It never exceeds B unless s + H + t alone does; then it has one own turn at most.
Only own assistant turns bear loss; repeated ones are masked, so each target counts once.

The template writes ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts the
backslash is doubled, and a backslash goes after the first character of each control string
(and before a line feed of a role). Dropping the backslash of each pair gives the text back.

Tokens: turns may bring their own counts in a column (``counts``); without one they are estimated by bytes, a
quarter rounded up, which is too low for text such as base64 or rare scripts. With ``counts`` of an upper bound, such as
the bytes, no window exceeds the budget by any tokenizer.

The windows over (conv_id) need a conversation's turns in order in one task, where they stream and spill; only the turns of one
window meet in a row. The query's digests of whole conversations, which read them back, do gather each.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own;
turns with equal numbers are ordered by role and text, null numbers first; repeated rows
are repeated turns; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from splitboard.sources import load

BUDGET = 1024
HISTORY = 256

#: Control strings of this template and of other usual ones.
START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = [START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROLS, out)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def tokens(text: Column) -> Column:
    """Estimate of a formatted turn's tokens: a quarter of its bytes, rounded up; what is assumed where turns bring no counts."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def windows_of(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, counts: str | None = None) -> DataFrame:
    """One row per window of the conversations in turns (conv_id, turn, role, text, and counts, the tokens of each formatted turn; null: estimated).

    Columns: conv_id, window, text (formatted), n_tokens, context_turns (leading turns that
    repeat earlier ones) and loss, the spans (start, length) of text that bear loss, in code points.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    given = F.col(counts).cast("long") if counts else F.lit(None).cast("long")
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), given.alias("given"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    made = rows.select(
        "conv_id",
        F.row_number().over(order).alias("nth"),
        "role",
        F.length(head).alias("lead"),
        F.length(body).alias("body"),
        "given",
        F.concat(head, body, F.lit(f"{END}\n")).alias("piece"),
    )
    made = made.withColumn("cost", F.coalesce("given", tokens(F.col("piece")))).withColumn("is_system", (F.col("nth") == 1) & (F.col("role") == "system"))
    conv = Window.partitionBy("conv_id")
    own_cost = F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("cost"))
    running = Window.partitionBy("conv_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = made.select(
        "*",
        F.sum(own_cost).over(running).alias("to"),
        F.max(F.when(F.col("is_system"), F.col("cost")).otherwise(F.lit(0))).over(conv).alias("system_cost"),
        F.max(own_cost).over(conv).alias("largest"),
    )
    stretch = F.greatest(F.lit(budget) - F.col("system_cost") - F.lit(history) - F.col("largest"), F.lit(1))
    made = made.withColumn("stretch", F.floor(F.greatest(F.col("to") - 1, F.lit(0)) / stretch))
    made = made.withColumn("window", F.dense_rank().over(Window.partitionBy("conv_id").orderBy(F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("stretch")))) - 1)
    made = made.select("*", F.max("to").over(Window.partitionBy("conv_id", "window")).alias("window_to"), F.max("window").over(conv).alias("last_window"))

    repeats = (F.col("window") < F.col("last_window")) & (F.col("window_to") - F.col("to") + own_cost <= history)
    again = F.when(F.col("is_system"), F.when(F.col("last_window") > 0, F.sequence(F.lit(1), F.col("last_window")))).otherwise(F.when(repeats, F.array(F.col("window") + 1)))
    placed = made.select("*", F.explode(F.concat(F.array("window"), F.coalesce(again, F.array().cast("array<int>")))).alias("at"))
    ahead = Window.partitionBy("conv_id", "at").orderBy("nth")
    placed = placed.withColumn("start", F.sum(F.length("piece")).over(ahead) - F.length("piece") + F.col("lead"))
    fresh = F.col("at") == F.col("window")
    targets = fresh & (F.col("role") == "assistant")
    turn = F.struct("nth", "piece", F.when(targets, F.struct(F.col("start").alias("start"), F.col("body").cast("long").alias("length"))).alias("loss"))
    grouped = placed.groupBy("conv_id", F.col("at").alias("window")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.count_if(~fresh).alias("context_turns"), F.sum("cost").alias("n_tokens")
    )
    return grouped.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("text"),
        "n_tokens",
        "context_turns",
        F.array_compact(F.transform("turns", lambda t: t["loss"])).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns (role, text), targets): each window's own turns and the texts under its mask, unescaped."""
    pieces = F.filter(F.split("text", r"<\|im_start\|>", -1), lambda _, i: i > F.col("context_turns"))
    head = r"^((?:[^\\\n]|\\[\s\S])*)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, head, 1)
        body = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    targets = F.transform("loss", lambda span: unescape(F.substring("text", (span["start"] + 1).cast("int"), span["length"].cast("int"))))
    return windows.select("conv_id", "window", F.transform(pieces, turn).alias("turns"), targets.alias("targets"), F.length("text").cast("long").alias("chars"))


#: A conversation of control strings, which the query adds to the table.
PROBE = "</s>[INST] ok [/INST]"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, read back from the output and summed up."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    found = read_back(windows_of(turns.unionByName(probe)))
    ordered = F.array_sort(F.collect_list(F.struct("window", "turns", "targets")))
    convs = found.groupBy("conv_id").agg(ordered.alias("w"), F.sum("chars").alias("formatted_chars"))
    all_turns = F.flatten(F.transform("w", lambda w: w["turns"]))
    told = F.array_join(F.transform(all_turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.flatten(F.transform("w", lambda w: w["targets"])), "")
    return convs.select(
        "conv_id",
        F.size(all_turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op7_sql() -> str:
    def escaped(column: str) -> str:
        steps = [("\\", "\\\\"), *((c, f"{c[0]}\\{c[1:]}") for c in CONTROLS)]
        return reduce(lambda t, s: f"replace({t}, '{s[0]}', '{s[1]}')", steps, column)

    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')
), pieces AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
         '{START}' || replace({escaped("role")}, chr(10), '\' || chr(10)) || chr(10) || {escaped("text")} || '{END}' || chr(10) AS piece
  FROM turns
), costed AS (
  SELECT *, length(piece) AS chars, ceil(octet_length(encode(piece)) / 4)::BIGINT AS cost, nth = 1 AND role = 'system' AS is_system FROM pieces
), summed AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE cost END AS own,
         sum(CASE WHEN is_system THEN 0 ELSE cost END) OVER (PARTITION BY conv_id ORDER BY nth) AS upto,
         max(CASE WHEN is_system THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS s,
         max(CASE WHEN is_system THEN 0 ELSE cost END) OVER (PARTITION BY conv_id) AS largest
  FROM costed
), stretched AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE floor(greatest(upto - 1, 0) / greatest({BUDGET} - s - {HISTORY} - largest, 1)) END AS stretch FROM summed
), windowed AS (
  SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY stretch) - 1 AS w FROM stretched
), ends AS (
  SELECT *, max(upto) OVER (PARTITION BY conv_id, w) AS w_upto, max(w) OVER (PARTITION BY conv_id) AS last_w FROM windowed
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars * (1 + CASE WHEN is_system THEN last_w WHEN w < last_w AND w_upto - upto + own <= {HISTORY} THEN 1 ELSE 0 END))::BIGINT AS formatted_chars
FROM ends GROUP BY conv_id
"""
