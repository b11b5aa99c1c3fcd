"""Study definitions and responses from files."""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ANSWER = "valueCoding:struct<system:string,code:string,display:string>,valueBoolean:boolean,valueDecimal:double,valueInteger:bigint,valueDate:string,valueDateTime:string,valueString:string,extension:array<struct<url:string,valueDecimal:double>>"


def _items(depth: int, probe: bool = False) -> str:
    below = f",item:{_items(depth - 1, probe)}" if depth > 1 else ",item:string" if probe else ""
    return f"array<struct<linkId:string,answer:array<struct<{_ANSWER}>>{below}>>"


def response_schema(depth: int = 3, probe: bool = False) -> str:
    """Schema of a questionnaire response with items nested ``depth`` deep; with ``probe`` what lies deeper is read as text."""
    return f"resourceType string, id string, status string, questionnaire string, authored string, subject struct<reference:string>, item {_items(depth, probe)}"


def _deeper(items: Column, depth: int) -> Column:
    """Whether any item at ``depth`` has items of its own, read as text."""
    return F.exists(items, lambda x: x["item"].isNotNull() if depth == 1 else F.coalesce(_deeper(x["item"], depth - 1), F.lit(False)))


def read_responses(spark: SparkSession, path: str, depth: int | None = None, lines: bool = False) -> DataFrame:
    """Questionnaire responses from JSON files holding one object or an array each, or one object a line (``lines``), which alone can be split.

    Items are read as deep as they are nested, found by a pass over the files; a given ``depth`` that is too small
    raises ValueError. Other resource types are left out; unreadable text gives no row.
    """
    read = lambda d, probe: spark.read.schema(response_schema(d, probe)).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    level = depth or 3
    while not read(level, True).where(_deeper(F.col("item"), level)).isEmpty():
        if depth:
            raise ValueError(f"items are nested more than {depth} deep")
        level += 2
    return read(level, False).where("resourceType = 'QuestionnaireResponse'")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, rows: int = 50_000) -> DataFrame:
    """A table of a SQLite file on the driver, read in blocks of ``rows`` and handed to Spark block by block.

    Such files hold one site's study. A name that isn't a table raises ValueError.
    """
    from cohortspark.operators.storage import new_path

    target, names = new_path(spark, f"sqlite-{table}"), [c.strip().split()[0] for c in schema.split(",")]
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        if not db.execute("select 1 from sqlite_master where type in ('table', 'view') and name = ?", (table,)).fetchone():
            raise ValueError(f"no table {table!r}")
        found = db.execute(f'select {", ".join(chr(34) + n + chr(34) for n in names)} from "{table}"')
        first = True
        while (block := found.fetchmany(rows)) or first:
            spark.createDataFrame(block, schema).coalesce(1).write.mode("append").parquet(target)
            first = False
    return spark.read.schema(schema).parquet(target)


def run_sql_file(spark: SparkSession, text: str) -> list[DataFrame]:
    """Runs the statements of a SQL text one after the other; semicolons in quotes and comments don't part statements."""
    statements, current, quote, i = [], "", "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif c == ";":
            statements.append(current)
            current, i = "", i + 1
            continue
        current, i = current + c, i + 1
    return [spark.sql(s) for s in [*statements, current] if s.strip()]


def read_instrument(text: str) -> dict[str, list[dict]]:
    """Rows of question, response_option and placement tables from an instrument written in YAML.

    Question ids follow the order of the text. A gate (``show_when``), a scale's items and similar rules are kept as
    text, not interpreted. A repeated link_id or a question without type raises ValueError.
    """
    import yaml

    q = yaml.safe_load(text)["questionnaire"]
    sections = q.get("sections") or [{"title": None, "questions": q.get("questions", [])}]
    out: dict[str, list[dict]] = {"questionnaire": [{"questionnaire_id": 1, "name": q["name"], "version": str(q.get("version", "1.0")), "canonical_url": q.get("canonical_url")}], "question": [], "response_option": [], "questionnaire_question": []}
    seen: set[str] = set()

    def add(item: dict, section: int, parent: int | None) -> None:
        link = item["link_id"]
        if link in seen or "type" not in item:
            raise ValueError(f"question {link!r} is repeated or has no type")
        seen.add(link)
        number = len(out["question"]) + 1
        low, high = (item.get("range") or [None, None])[:2]
        out["question"].append({"question_id": number, "link_id": link, "question_text": item.get("text", ""), "question_type": item["type"], "numeric_min": low, "numeric_max": high})
        out["questionnaire_question"].append({"qq_id": number, "questionnaire_id": 1, "question_id": number, "display_order": number - 1, "section": section, "parent_qq_id": parent, "is_required": int(bool(item.get("required")))})
        options = item.get("options") or (q.get("option_sets") or {}).get(item.get("$set"), [])
        for place, o in enumerate(options):
            o = o if isinstance(o, dict) else {"text": str(o), "value": str(o)}
            out["response_option"].append({"option_id": len(out["response_option"]) + 1, "question_id": number, "option_text": o["text"], "option_value": str(o.get("value", o["text"])), "display_order": place})
        for child in item.get("items") or []:
            add(child, section, number)

    for n, section in enumerate(sections):
        for item in section.get("questions", []):
            add(item, n, None)
    return out
