"""Chat formatting in budgeted windows (native: DataFrame expressions only).

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a span is the turns that
start in the same stretch of `stride` tokens; a turn longer than a stride stands alone. Sums are
taken inside blocks of turns and then over block totals, so a long conversation is many tasks'
work. A window is the conversation's leading system turn, the turns of the last `history` tokens
before the span, and the span. Repeated turns are masked: only the span's own assistant texts
carry loss, so every assistant text is a target exactly once.

Template: <|im_start|>role, newline, text, <|im_end|>, newline. Control strings inside texts get a
backslash behind their first character (one more if there are some), which unescape() takes away.
A turn counts as one token for every two of its bytes (BYTES_A_TOKEN) and four more: byte-level vocabularies of 50,000
tokens need no more than that for prose in Latin or Chinese script, so a window that keeps its budget here keeps it there.

Defined results: null text or role is empty; turns are ordered by (turn, nulls first; role; text);
repeated rows are separate turns; rows with a null conv_id form one conversation of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evloom.session import written

BUDGET, HISTORY, SYSTEM = 1024, 256, 128
BLOCK_TURNS = 256
BYTES_A_TOKEN = 2
# What counts as a control string behind its first character, < or [.
CONTROL = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*+)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)" + CONTROL, r"$1$2$3")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, system: int = SYSTEM) -> DataFrame:
    """turns (conv_id, turn, role, text) -> one row per window: conv_id, window (ordinal), formatted, turns (idx, part:
    0 system, 1 history, 2 own; loss), loss (start, length in code points of formatted), n_tokens, over_budget."""
    stride = max(1, (budget - history - system) // 2)
    # the conversation as a struct: equal to itself even where the id is null
    df = turns.select(F.struct("conv_id").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    df = df.withColumn("head", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n")))
    df = df.withColumn("tok", F.expr(f"cast((octet_length(head) + octet_length(body) + {len(CLOSE) + 1}) div {BYTES_A_TOKEN} + 4 as long)"))
    df = df.withColumn("blk", F.expr(f"coalesce(turn div {BLOCK_TURNS}, -9223372036854775808)"))
    inside = Window.partitionBy("c", "blk").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    df = df.withColumn("s", F.sum("tok").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tok")).withColumn("i", F.row_number().over(inside) - 1)
    # texts are written once; what follows reads the slim columns and meets the texts again at the end
    df = written(df.select("c", "blk", "i", "s", "tok", "role", "head", "body"), "turns")
    before = Window.partitionBy("c").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy("c", "blk").agg(F.sum("tok").alias("bt"), F.count("*").alias("bn"))
    blocks = blocks.select("c", "blk", F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("bs"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bi"))
    slim = df.select("c", "blk", "i", "s", "tok", (F.col("role") == "system").alias("sys")).join(blocks, ["c", "blk"])
    slim = slim.select("c", "blk", "i", "tok", "sys", (F.col("s") + F.col("bs")).alias("s"), (F.col("i") + F.col("bi")).cast("long").alias("idx"))
    slim = slim.withColumn("own", F.expr(f"(s div {stride}) * 2 + if(tok > {stride}, 1, 0)"))  # windows in order: bucket, then its long turn
    place = ["c", "blk", "i", "idx", "tok"]
    first = slim.groupBy("c", F.col("own").alias("w")).agg(F.min("s").alias("w0"))
    own = slim.select(*place, F.col("own").alias("w"), F.lit(2).alias("part"))
    # a turn is history of spans that start within `history` tokens of its own start
    reach = f"if((s + tok) div {stride} <= (s + {history}) div {stride}, sequence((s + tok) div {stride} * 2, (s + {history}) div {stride} * 2 + 1), array())"
    past = slim.where("not (idx = 0 and sys)").select(*place, (F.col("s") + F.col("tok")).alias("h1"), (F.col("s") + history).alias("h2"), F.explode(F.expr(reach)).alias("w"))
    hist = past.join(first, ["c", "w"]).where("w0 between h1 and h2").select(*place, "w", F.lit(1).alias("part"))
    lead = slim.where("idx = 0 and sys").join(first, "c").where("w > own").select(*place, "w", F.lit(0).alias("part"))
    member = own.unionAll(hist).unionAll(lead).drop("tok")
    parts = member.join(df.drop("s"), ["c", "blk", "i"])
    whole = F.concat("head", "body", F.lit(CLOSE + "\n")).alias("whole")
    t = F.struct("idx", "role", "head", "body", whole, "tok")
    rows = parts.groupBy("c", "w").agg(F.array_sort(F.collect_list(F.struct("part", "idx", t.alias("t")))).alias("p"))  # a budget's worth of turns
    rows = rows.withColumn(
        "at",
        F.expr("aggregate(p, named_struct('n', 0L, 'a', cast(array() as array<bigint>)), (x, y) -> named_struct('n', x.n + length(y.t.whole), 'a', array_append(x.a, x.n)), x -> x.a)"),
    )
    rows = rows.withColumn("turns", F.expr("transform(p, (x, i) -> struct(x.idx as idx, x.part as part, x.part = 2 and x.t.role = 'assistant' as loss))"))
    rows = rows.withColumn(
        "loss", F.expr("filter(transform(p, (x, i) -> if(x.part = 2 and x.t.role = 'assistant', struct(at[i] + length(x.t.head) as start, cast(length(x.t.body) as bigint) as length), null)), x -> x is not null)")
    )
    rows = rows.withColumn("n_tokens", F.expr("aggregate(p, 0L, (x, y) -> x + y.t.tok)"))
    return rows.select(
        F.col("c.conv_id").alias("conv_id"), F.col("w").alias("window"), F.expr("array_join(transform(p, x -> x.t.whole), '')").alias("formatted"),
        "turns", "loss", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """windows() -> one row per own turn, parsed from the formatted text: conv_id, idx, role, text."""
    pieces = formatted.select("conv_id", "turns", F.expr(r"slice(split(formatted, '<\\|im_start\\|>'), 2, 1000000000)").alias("x"))
    pieces = pieces.select("conv_id", F.explode(F.arrays_zip("turns", "x")).alias("z")).where("z.turns.part = 2")
    tail = len(CLOSE) + 1
    return pieces.select(
        "conv_id", F.col("z.turns.idx").alias("idx"), F.url_decode(F.substring_index("z.x", "\n", 1)).alias("role"),
        unescape(F.expr(f"substring(z.x, instr(z.x, '\\n') + 1, length(z.x) - instr(z.x, '\\n') - {tail})")).alias("text"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = windows(turns.unionByName(extra))
    back = read_back(rows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "role", "text"))).alias("t"))
    back = back.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(F.expr("array_join(transform(t, x -> concat(x.role, '\\n', x.text, '\\n')), '')"), 256).alias("turns_sha256")
    )
    targets = rows.select(
        "conv_id", "window", F.length("formatted").cast("long").alias("n"),
        F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int")))).alias("texts"),
    )
    loss = targets.groupBy("conv_id").agg(
        F.expr("array_join(flatten(transform(array_sort(collect_list(struct(window, texts))), x -> x.texts)), '')").alias("loss"), F.sum("n").alias("formatted_chars")
    )
    loss = loss.select(F.col("conv_id").alias("c"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    return back.join(loss, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


SQL = r"""
WITH c AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<|im_start|>' || url_encode(role) || chr(10) || regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS whole FROM c),
t AS (SELECT *, strlen(whole) // 2 + 4 AS tok FROM e),
o AS (SELECT *, sum(tok) OVER o - tok AS s, row_number() OVER o - 1 AS idx FROM t WINDOW o AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, whole ROWS UNBOUNDED PRECEDING)),
x AS (SELECT *, CAST(s AS BIGINT) // 320 * 2 + (tok > 320)::BIGINT AS own FROM o),
f AS (SELECT c, own AS w, min(s) AS w0 FROM x GROUP BY ALL),
r AS (SELECT x.c, length(whole) AS n FROM x JOIN f ON f.c = x.c AND f.w0 BETWEEN x.s + x.tok AND x.s + 256 WHERE NOT (idx = 0 AND role = 'system')
  UNION ALL SELECT x.c, length(whole) FROM x JOIN f ON f.c = x.c AND f.w > x.own WHERE idx = 0 AND role = 'system'),
again AS (SELECT c, sum(n) AS n FROM r GROUP BY c),
g AS (SELECT c, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY idx) FILTER (WHERE role = 'assistant'), '') AS loss, sum(length(whole)) AS n FROM x GROUP BY c)
SELECT g.c AS conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, (g.n + coalesce(again.n, 0))::BIGINT AS formatted_chars FROM g LEFT JOIN again ON g.c = again.c
"""
