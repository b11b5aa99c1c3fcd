"""Entity, attribute, value rows reshaped into one typed row for each entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.functions import answers
from cohortspark.functions.text import blank_to_null
from cohortspark.operators.skew import broadcast_if_small

#: A wide table with more columns than this is refused.
MAX_COLUMNS = 10_000
#: Type of the column for each question type; other types hold option codes.
TYPES = {"numeric": "double", "slider": "double", "boolean": "boolean", "date": "date", "datetime": "date"}


@dataclass(frozen=True)
class Attribute:
    """One column of the wide table."""

    name: str
    question_type: str

    @property
    def type(self) -> str:
        return TYPES.get(self.question_type, "string")


def typed_answers(facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Rows with a usable value: session_id, attribute, question_type, value (string form), loaded_at, response_id.

    Questions absent from ``questions`` have no attribute. A value that doesn't fit the type's column is looked
    for in response_text; what remains unusable (blank, non-answer, wrong form, no finite number) gives no row.
    """
    q = questions.groupBy("question_id").agg(F.min(F.struct("link_id", "question_type")).alias("q")).select("question_id", "q.*").where("link_id is not null")
    f = facts.select("session_id", "question_id", "repeat_index", "response_text", "response_numeric", "response_date", "response_boolean", "option_value", "loaded_at", "response_id").join(broadcast_if_small(q), "question_id")
    text, kind = F.col("response_text"), F.col("question_type")
    number = F.when(~F.isnan("response_numeric") & (F.abs("response_numeric") < 1e300), F.col("response_numeric"))
    value = (
        F.when(kind.isin("numeric", "slider"), F.coalesce(number, answers.number(text)).cast("string"))
        .when(kind == "boolean", F.coalesce("response_boolean", answers.boolean(text)).cast("string"))
        .when(kind.isin("date", "datetime"), F.coalesce("response_date", answers.date(text)).cast("string"))
        .when(kind == "text", blank_to_null(text))
        .otherwise(F.coalesce(answers.code(F.col("option_value")), answers.code(text)))
    )
    name = F.concat(F.col("link_id"), F.coalesce(F.concat(F.lit("#"), F.col("repeat_index")), F.lit("")))
    return f.select("session_id", name.alias("attribute"), "question_type", value.alias("value"), "loaded_at", "response_id").where("value is not null and session_id is not null")


def discover(facts: DataFrame, questions: DataFrame) -> list[Attribute]:
    """The attributes that occur, by name; their number is bounded by MAX_COLUMNS, beyond which it fails.

    Two questions with one link_id share a column, with the type that comes first by name.
    """
    seen = facts.select("question_id", "repeat_index").distinct()
    q = questions.select("question_id", "link_id", "question_type").where("link_id is not null")
    name = F.concat(F.col("link_id"), F.coalesce(F.concat(F.lit("#"), F.col("repeat_index")), F.lit("")))
    found = seen.join(broadcast_if_small(q), "question_id").groupBy(name.alias("name")).agg(F.min("question_type").alias("question_type")).orderBy("name").limit(MAX_COLUMNS + 1).collect()
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} attributes")
    return [Attribute(r["name"], r["question_type"]) for r in found]


def cells(rows: DataFrame) -> DataFrame:
    """One value for each session and attribute: the latest loaded, among equals the highest response_id; of multiple
    choices all distinct codes, ascending, joined by ``|``. Repeats are combined before the shuffle."""
    several = F.col("question_type") == "multiple_choice"
    order = F.struct("loaded_at", "response_id", "value")
    return (
        rows.groupBy("session_id", "attribute")
        .agg(F.max(F.when(~several, order)).alias("last"), F.collect_set(F.when(several, F.col("value"))).alias("all"))
        .select("session_id", "attribute", F.coalesce("last.value", F.array_join(F.array_sort("all"), "|")).alias("value"))
    )


def wide_table(facts: DataFrame, questions: DataFrame, attributes: list[Attribute] | None = None) -> DataFrame:
    """One row for each session that has a usable answer, one typed column for each attribute.

    After :func:`cells` a session holds at most one row an attribute, so gathering a session in one task is bounded
    by the number of columns. Columns come in the order of ``attributes``.
    """
    attributes = discover(facts, questions) if attributes is None else attributes
    one = cells(typed_answers(facts, questions)).repartition("session_id")
    picks = [F.first(F.when(F.col("attribute") == a.name, F.col("value")), ignorenulls=True).alias(f"c{i}") for i, a in enumerate(attributes)]
    wide = one.groupBy("session_id").agg(*picks) if picks else one.select("session_id").distinct()
    return wide.select("session_id", *(F.col(f"c{i}").cast(a.type).alias(a.name) for i, a in enumerate(attributes)))


def filled_cells(wide: DataFrame, attributes: list[Attribute]) -> DataFrame:
    """The wide table's filled cells as text: session_id, col, cell."""
    if not attributes:
        return wide.select("session_id", F.lit("").alias("col"), F.lit("").alias("cell")).limit(0)
    text = [F.struct(F.lit(a.name).alias("col"), (answers.two_decimals(c) if a.type == "double" else c.cast("string")).alias("cell")) for a in attributes for c in [F.col(f"`{a.name}`")]]
    return wide.select("session_id", F.inline(F.filter(F.array(*text), lambda x: x["cell"].isNotNull())))
