"""Text batch jobs as column expressions: answer parsing, transcripts, prompts, scoring hook.

Everything except the optional user scorer is a built-in expression, so a
whole table of answers or transcripts is parsed inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cinelake.functions import text as T

# Fixed values of the answer and transcript formats.
SECTION_SEP = "---"
ITEM_SEP = ";;;"
RATING_SEP = ": "
EMPTY = "<EMPTY>"
TURN_BREAK = "<LINEBREAK>"
INST_END = "[/INST]"
SYSTEM_MESSAGE = "You are a helpful assistant."
FITNESS_ERROR = "ERROR: Failed to parse the answer."
FITNESS_DEFAULT = 3.0
MOOD_SENTENCE = " Currently, I'm in a mood for "
PLOT_FORMAT = 'Plot of "%s": %s'
EXPLAIN_RS_ONLY = "Only RS recommendations used."
EXPLAIN_NO_PREFERENCES = "No general preferences found in user's prompt."
EXPLAIN_NO_PLOT = "Movie plot not found."
# Fixed values of the two prompt formats: marks before and after a conversation and a request.
CHAT_MARKS = ("", "", TURN_BREAK, TURN_BREAK)
INSTRUCTION_MARKS = ("<s>", "[INST]", INST_END, "</s>")

_LAST_PAIR = r"(?s)^(.*): (.*)$"


def parse_answer(answer: Column) -> Column:
    """STRUCT<ratings ARRAY<STRUCT<name, rating>>, preferences STRING>.

    Exactly two sections around '---' or both NULL; '<EMPTY>' on a side makes it
    NULL; every ';;;' piece is split at its last ': ' into (name, float) or the
    whole ratings list is NULL; names are not trimmed.
    """
    parts = F.split(answer, SECTION_SEP, -1)
    two = F.size(parts) == 2
    left = T.py_strip(parts.getItem(0))
    right = parts.getItem(1)
    prefs = F.when(two & ~right.contains(EMPTY), T.py_strip(right))
    items = F.split(left, ITEM_SEP, -1)
    piece_ok = lambda x: x.rlike(_LAST_PAIR) & T.is_decimal(F.regexp_extract(x, _LAST_PAIR, 2))
    valid = two & ~left.contains(EMPTY) & F.forall(items, piece_ok)
    pairs = F.transform(
        items,
        lambda x: F.struct(
            F.regexp_extract(x, _LAST_PAIR, 1).alias("name"), T.to_double(F.regexp_extract(x, _LAST_PAIR, 2)).alias("rating")
        ),
    )
    return F.struct(F.when(valid, pairs).alias("ratings"), prefs.alias("preferences"))


def parse_answers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per parsed rating (pos from 0); an answer without ratings keeps one row with NULLs."""
    p = df.select(id_col, parse_answer(F.col(text_col)).alias("_p"))
    return p.select(
        id_col,
        F.col("_p.preferences").alias("preferences"),
        F.col("_p.ratings").isNotNull().alias("ratings_ok"),
        F.posexplode_outer("_p.ratings").alias("pos", "_r"),
    ).select(id_col, "pos", F.col("_r.name").alias("name"), F.col("_r.rating").alias("rating"), "preferences", "ratings_ok")


def parse_fitness(answer: Column) -> Column:
    """'<score> --- <text>': bad number -> (3, error text); missing separator -> explanation NULL."""
    parts = F.split(answer, SECTION_SEP, -1)
    head = T.py_strip(parts.getItem(0))
    score = T.to_double(head)
    expl = F.when(F.size(parts) >= 2, T.py_strip(parts.getItem(1)))
    return F.struct(
        F.coalesce(score, F.lit(FITNESS_DEFAULT)).alias("score"),
        F.when(score.isNull(), F.lit(FITNESS_ERROR)).otherwise(expl).alias("explanation"),
    )


def completion_answer(text: Column) -> Column:
    """The part after the last '[/INST]', trimmed."""
    return T.py_strip(F.substring_index(text, INST_END, -1))


def transcript_messages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """System message, then pieces split on '<LINEBREAK>' (last piece dropped), alternating user/assistant."""
    pieces = F.split(T.py_strip(F.col(text_col)), TURN_BREAK, -1)
    kept = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = df.select(id_col, F.posexplode(kept).alias("_i", "_t")).select(
        id_col,
        (F.col("_i") + 1).alias("msg_pos"),
        F.when(F.col("_i") % 2 == 0, "user").otherwise("assistant").alias("role"),
        T.py_strip("_t").alias("content"),
    )
    system = df.select(id_col, F.lit(0).alias("msg_pos"), F.lit("system").alias("role"), F.lit(SYSTEM_MESSAGE).alias("content"))
    return system.unionByName(turns)


# ------------------------------------------------------------------ prompts (our own wording)


def prompt_marks(instruction: bool) -> tuple[str, str, str, str]:
    """Marks that open a conversation, open a request, close a request and close an answer."""
    return INSTRUCTION_MARKS if instruction else CHAT_MARKS


FEW_SHOT = [
    (
        "I loved 'Arrival' and 'Contact' but 'Armageddon' bored me. Something quiet and thoughtful, please.",
        "Arrival: 5;;;Contact: 5;;;Armageddon: 2 --- I want a quiet, thoughtful film.",
    ),
    ("Show me a film about a long train journey.", "<EMPTY> --- I want a film about a long train journey."),
    ("'Heat' is great and 'Ronin' is fine.", "Heat: 5;;;Ronin: 4 --- <EMPTY>."),
    ("", "<EMPTY> --- <EMPTY>."),
]


def extraction_parts(instruction: bool) -> tuple[str, str]:
    """(text before, text after) the user's request in the few-shot extraction prompt."""
    begin, ask, asked, answered = prompt_marks(instruction)
    total = len(FEW_SHOT) + (1 if instruction else 2)
    last = total if instruction else total - 1
    parts = [
        f"{begin}{ask}You will read {total} requests. For each, list the movies the writer mentions "
        f"with a 1-5 score as '<movie_name>: <rating>' joined by ';;;', then ' --- ' and their general wish; "
        f"write <EMPTY> for a missing side.{asked}\nReady.{answered}\n"
    ]
    for i, (q, a) in enumerate(FEW_SHOT, start=1):
        parts.append(f"{ask}Request {i}/{total}: \"{q}\"{asked}\n{a}{answered}\n")
    parts.append(f"{ask}Request {last}/{total}: \"")
    return "".join(parts), f"\"{asked}"


def extraction_prompt(user_text: Column, instruction: bool) -> Column:
    """Few-shot prompt: numbered examples, then the user's text as the last request."""
    head, tail = extraction_parts(instruction)
    return F.concat(F.lit(head), user_text, F.lit(tail))


def fitness_parts(instruction: bool) -> tuple[str, str, str]:
    begin, ask, asked, _ = prompt_marks(instruction)
    return (
        f"{begin}{ask}Score from 1 to 5 how well the movie plot below suits the viewer's wishes, "
        "then give one short reason, as '<rating_number> --- <reason>.'\n\nWishes: \"",
        "\".\n",
        asked,
    )


def fitness_prompt(preferences: Column, plot: Column, instruction: bool) -> Column:
    a, b, c = fitness_parts(instruction)
    return F.concat(F.lit(a), preferences, F.lit(b), plot, F.lit(c))


def plot_text(title: Column, plot: Column) -> Column:
    return F.format_string(PLOT_FORMAT, title, plot)


# ------------------------------------------------------------------ scoring hook


def overlap_score(preferences: Column, plot: Column) -> Column:
    """Bundled deterministic scorer: 1 + number of distinct lower-case words shared, capped at 5."""
    shared = F.size(F.array_intersect(F.split(F.lower(preferences), " "), F.split(F.lower(plot), " ")))
    return F.least(F.lit(5), F.lit(1) + shared).cast("double")


def overlap_answer(preferences: Column, plot: Column) -> Column:
    """The bundled scorer's answer in the model's text format '<score> --- <reason>'."""
    s = overlap_score(preferences, plot)
    return F.concat(s.cast("string"), F.lit(" --- Shares "), (s - 1).cast("int").cast("string"), F.lit(" words with the wishes."))


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Add ``answer`` for each (preferences, plot) row.

    Default: the built-in overlap scorer as a column expression.  A user scorer
    (e.g. a client for a hosted model) runs batch-wise in ``mapInPandas`` over
    Arrow batches, parallel across partitions.
    """
    if scorer is None:
        return pairs.withColumn("answer", overlap_answer(F.col("preferences"), F.col("plot")))

    # a new schema: ``StructType.add`` would change the input's cached schema in place
    schema = StructType([*pairs.schema.fields, StructField("answer", StringType())])

    def run(it):
        for pdf in it:
            pdf = pdf.copy()
            scores = scorer(pdf["preferences"], pdf["plot"])
            pdf["answer"] = pd.Series(scores).astype("string").to_numpy()  # by position, not by index label
            yield pdf

    return pairs.mapInPandas(run, schema)
