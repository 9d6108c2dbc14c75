"""Operator 7: preference formatting of chosen and rejected conversations. DataFrame functions only.

For a pair, the longest common prefix of turns is rendered once as the prompt; the turns after it are the two
completions, each with the spans that count for the loss (the texts of the trained role).
A conversation is one record and has to fit a row, as the rendered text does: one over ``MOST_BYTES`` is an error before any
is gathered. A turn without key is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftward.llm.common import cut_lineage, table
from siftward.llm.mixing import hashed

TRAINED = "assistant"
START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
#: Conversations among which one finds its counterpart, on average.
RING = 1000
SEED = 23
#: Text of a conversation, in bytes: rendered on both sides of a pair it has to fit a row and a task.
MOST_BYTES = 64 << 20
#: What a turn counts besides its text.
TURN_BYTES = 64
TURNS = "array<struct<role: string, text: string>>"


def gathered(turns: DataFrame, key: str = "conv_id", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per conversation: ``turns``, role and text in order of turn.

    Null turns come first; turns of equal number are ordered by role and text. Null roles and texts
    are empty; a row without key is a conversation of its own. The markers' opening ``<|`` inside a role or a text is written ``< |``.
    Sizes are summed first: a conversation of more than ``most_bytes`` is an error.
    """
    clean = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias(c) for c in ("role", "text")]
    rows = turns.select(key, "turn", *clean)
    held = rows.where(F.col(key).isNotNull())
    size = F.octet_length("role") + F.octet_length("text") + F.lit(TURN_BYTES)
    large = held.groupBy(key).agg(F.sum(size.cast("long")).alias("size")).where(F.col("size") > most_bytes)
    found = large.agg(F.count(F.lit(1)).alias("n"), F.max_by(F.col(key).cast("string"), "size").alias("name"), F.max("size").alias("size")).first()
    if found.n:
        raise ValueError(f"{found.n} conversations of more than {most_bytes} bytes, the largest {found.name!r} of {found.size}")
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    bare = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    single = rows.where(F.col(key).isNull()).select(key, F.array(F.struct("role", "text")).alias("turns"))
    return held.groupBy(key).agg(bare.alias("turns")).union(single)


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two lists of turns."""
    most = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.transform(F.slice(a, 1, most), lambda t, i: t != b[i]), True)
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(most)


def turn_text(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(STOP))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, turn_text), "")


def spans(turns: Column, trained: str) -> Column:
    """``start-stop`` of the trained role's texts with their end marker, in characters of the rendered turns."""
    begun = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(t["role"]) + F.lit(len(START) + len(MIDDLE))
        stop = start + F.length(t["text"]) + F.lit(len(STOP) - 1)
        span = F.concat_ws("-", start.cast("string"), stop.cast("string"))
        return F.struct(
            (stop + 1).alias("at"),
            F.when(t["role"] == trained, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(turns, begun, add, lambda x: F.array_join(x["spans"], ","))


def after(turns: str, n: str) -> Column:
    return F.slice(F.col(turns), F.col(n) + 1, F.size(turns))


def formatted(pairs: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Pairs with ``chosen`` and ``rejected`` (lists of turns) as texts; other columns stay as they are.

    Adds n_prompt_turns, prompt, chosen_text, chosen_spans, rejected_text and rejected_spans in place of the two lists.
    A null list is empty. Where a conversation begins with all of the other, that one's completion is empty; equal ones
    are all prompt.
    """
    none = F.array().cast(TURNS)
    sides = pairs.withColumns({c: F.coalesce(F.col(c), none) for c in ("chosen", "rejected")})
    parts = sides.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    parts = parts.withColumn("prompt", rendered(F.slice("chosen", 1, F.col("n_prompt_turns"))))
    for side in ("chosen", "rejected"):
        rest = after(side, "n_prompt_turns")
        parts = parts.withColumns({f"{side}_text": rendered(rest), f"{side}_spans": spans(rest, trained)})
    return parts.drop("chosen", "rejected")


def unanswered(whole: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Gathered conversations without an answer, as pairs with nothing rejected and no partner."""
    none = ~F.exists("turns", lambda t: t["role"] == trained)
    partner = F.lit(None).cast(whole.schema["conv_id"].dataType)
    return whole.where(none).select("conv_id", partner.alias("partner_id"), F.col("turns").alias("chosen"), F.array().cast(TURNS).alias("rejected"))


def paired(
    turns: DataFrame, trained: str = TRAINED, ring: int = RING, seed: int = SEED, whole: DataFrame | None = None
) -> DataFrame:
    """Pairs from conversations that have no ranked answers: conv_id, partner_id, chosen, rejected.

    Chosen is a conversation up to its last answer (turn of the trained role); one without answers makes no pair.
    Its counterpart is the next conversation, by first turn and hash, in a ring of about ``ring`` dealt by a hash.
    Rejected is the counterpart itself where both open with the same turn, else the same turns with its
    last answer instead. Alone in its ring, a conversation is its own counterpart. Conversations without key are dealt
    by their text. ``whole`` are the gathered conversations, where they are known.
    """
    whole = gathered(turns) if whole is None else whole
    answers = F.transform(F.col("turns"), lambda t: t["role"] == trained)
    last = F.size("turns") - F.array_position(F.reverse(answers), True) + 1
    cut = whole.where(F.array_contains(answers, True)).withColumn("turns", F.slice("turns", 1, last.cast("int")))
    cut = cut_lineage(cut)
    rings = max(1, -(-cut.count() // ring))
    opening = F.col("turns")[0]
    name = F.coalesce(F.col("conv_id").cast("string"), F.concat_ws("|", F.lit("null"), opening["role"], opening["text"]))
    number = F.conv(F.substring(hashed(F.lit(f"{seed}-ring"), name), 1, 12), 16, 10).cast("long") % rings
    dealt = cut.withColumns({
        "ring": number,
        "opening": hashed(opening["role"], opening["text"]),
        "place": hashed(F.lit(f"{seed}-place"), name),
    })
    order = Window.partitionBy("ring").orderBy("opening", "place")
    other = F.struct("conv_id", "turns", "opening")
    around = F.first(other).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = dealt.withColumn("other", F.coalesce(F.lead(other).over(order), around))
    swapped = F.concat(
        F.slice("turns", 1, F.size("turns") - 1), F.slice(F.col("other.turns"), F.size("other.turns"), F.lit(1))
    )
    rejected = F.when(F.col("other.opening") == F.col("opening"), F.col("other.turns")).otherwise(swapped)
    return near.select("conv_id", F.col("other.conv_id").alias("partner_id"), F.col("turns").alias("chosen"), rejected.alias("rejected"))


def op7_preferences(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations: those without an answer have nothing rejected."""
    turns = table(spark, folder, "conversations")
    whole = cut_lineage(gathered(turns))
    return formatted(paired(turns, whole=whole).unionByName(unanswered(whole)))


def _sql_text(turns: str) -> str:
    return f"""coalesce(list_aggregate(list_transform({turns}, lambda t:
        '{START}' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), 'string_agg', ''), '')"""


def _sql_spans(turns: str) -> str:
    size = f"({len(START) + len(MIDDLE) + len(STOP)} + length(t.r) + length(t.x))"
    begin = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: {size})), 0)"
    start = f"CAST({begin} AS BIGINT) + {len(START) + len(MIDDLE)} + length({turns}[i].r)"
    return f"""coalesce(list_aggregate(list_transform(
        list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].r = '{TRAINED}'),
        lambda i: ({start}) || '-' || ({start} + length({turns}[i].x) + {len(STOP) - 1})), 'string_agg', ','), '')"""


ORACLE = f"""
WITH clean AS (
    SELECT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS r, replace(coalesce(text, ''), '<|', '< |') AS x,
        CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone
    FROM conversations
), whole AS (
    SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY turn NULLS FIRST, r, x) AS turns FROM clean GROUP BY conv_id, alone
), cut AS (
    SELECT conv_id, turns[1:list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].r = '{TRAINED}'))] AS turns
    FROM whole WHERE len(list_filter(turns, lambda t: t.r = '{TRAINED}')) > 0
), dealt AS (
    SELECT conv_id, turns, md5(turns[1].r || '|' || turns[1].x) AS opening,
        md5('{SEED}-place|' || coalesce(CAST(conv_id AS VARCHAR), 'null|' || turns[1].r || '|' || turns[1].x)) AS place,
        CAST('0x' || substr(md5('{SEED}-ring|' || coalesce(CAST(conv_id AS VARCHAR), 'null|' || turns[1].r || '|' || turns[1].x)), 1, 12) AS BIGINT)
            % (SELECT greatest(1, CAST(ceil(count(*) / {RING}) AS BIGINT)) FROM cut) AS ring
    FROM cut
), near AS (
    SELECT conv_id, a, opening, o.c AS partner_id, o.t AS other, o.o AS other_opening FROM (
        SELECT conv_id, turns AS a, opening, coalesce(lead(struct_pack(c := conv_id, t := turns, o := opening)) OVER w,
            first(struct_pack(c := conv_id, t := turns, o := opening)) OVER w) AS o
        FROM dealt WINDOW w AS (PARTITION BY ring ORDER BY opening, place))
), pairs AS (
    SELECT conv_id, partner_id, a,
        CASE WHEN other_opening = opening THEN other ELSE list_concat(a[1:len(a) - 1], other[len(other):len(other)]) END AS b
    FROM near
), split AS (
    SELECT conv_id, partner_id, a, b, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1),
        lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS n
    FROM pairs
), parts AS (
    SELECT conv_id, partner_id, n, a[1:n] AS p, a[n + 1:len(a)] AS c, b[n + 1:len(b)] AS d FROM split
    UNION ALL
    SELECT conv_id, NULL, 0, turns[1:0], turns, turns[1:0] FROM whole WHERE len(list_filter(turns, lambda t: t.r = '{TRAINED}')) = 0
)
SELECT conv_id, partner_id, CAST(n AS INT) AS n_prompt_turns, {_sql_text("p")} AS prompt,
    {_sql_text("c")} AS chosen_text, {_sql_spans("c")} AS chosen_spans,
    {_sql_text("d")} AS rejected_text, {_sql_spans("d")} AS rejected_spans
FROM parts
"""
