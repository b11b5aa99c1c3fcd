"""Nested form responses as flat tables of distinct objects, with Merkle identities.

Objects are canonicalised and hashed bottom-up: an answer over its present fields, an item
over its linkId, the hashes of its answers and those of its child items. Identical objects
are stored once; every occurrence is kept by rows that bridge record and place (the ordinals
from the top) to the item there, and by parent-child rows with ordinals between the objects.
The tables are an exact inverse of the records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions.answers import two_decimals
from cohortspark.operators.skew import spread_join
from cohortspark.operators.storage import stored

#: Distinct answers up to which their values are broadcast.
SMALL = 100_000
PLACE = ("rec_no", "path", "parent_link_id", "item_hash", "link_id", "answers", "children")


@dataclass(frozen=True)
class FlatTables:
    """Tables over ``places``, one row for each occurrence of an item: rec_no, path (ordinals from the top, joined by
    points), parent_link_id, item_hash (16 bytes), link_id, answers (hash and value by ordinal), children (hashes by ordinal)."""

    records: DataFrame
    places: DataFrame

    @property
    def roots(self) -> DataFrame:
        """rec_no, ordinal, item_hash of the items at the top; the hash of a null item is null."""
        return self.places.where(~F.col("path").contains(".")).select("rec_no", F.col("path").cast("int").alias("ordinal"), _hex(F.col("item_hash")).alias("item_hash"))

    @property
    def items(self) -> DataFrame:
        """item_hash, link_id, answers and children (hashes by ordinal) of the distinct items."""
        return self.distinct_items().select(_hex(F.col("item_hash")).alias("item_hash"), "link_id", F.transform("answers", _hex).alias("answers"), F.transform("children", _hex).alias("children"))

    @property
    def answers(self) -> DataFrame:
        """answer_hash, value of the distinct answers."""
        return self.distinct_answers().select(_hex(F.col("answer_hash")).alias("answer_hash"), "value")

    def distinct_items(self) -> DataFrame:
        """:attr:`items` with hashes as bytes. Equal hashes stand for equal rows, so it is a plain distinct, combined before its shuffle."""
        return self.places.where("item_hash is not null").select("item_hash", "link_id", F.col("answers.hash").alias("answers"), "children").distinct()

    def distinct_answers(self) -> DataFrame:
        """:attr:`answers` with hashes as bytes."""
        return self.places.select(F.explode("answers").alias("a")).where("a.hash is not null").select(F.col("a.hash").alias("answer_hash"), "a.value").distinct()

    def bridges(self) -> DataFrame:
        """Parent-child rows: parent_hash, child_kind, ordinal, child_hash."""
        parts = [self.items.select(F.col("item_hash").alias("parent_hash"), F.lit(k).alias("child_kind"), F.posexplode(c).alias("ordinal", "child_hash")) for k, c in (("item", "children"), ("answer", "answers"))]
        return parts[0].unionByName(parts[1])


def _hex(c: Column) -> Column:
    return F.lower(F.hex(c))


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "", null_handling="replace", null_replacement="")


def _canonical(values: pa.Array) -> pa.Array:
    """One text for each value, never null: present fields by number, texts with their length, so that no two values share one."""
    kind = values.type
    if pa.types.is_struct(kind):
        present = []
        for i, field in enumerate(values.flatten()):
            if field.null_count < len(field):
                present.append(pc.if_else(field.is_valid(), _joined(f"{i}:", _canonical(field)), ""))
        text = _joined("{", *present, "}")
    elif pa.types.is_list(kind):
        text = _joined("[", pc.binary_join(_lists(values, _canonical(values.flatten())), ","), "]")
    elif pa.types.is_string(kind):
        text = _joined(pc.utf8_length(values).cast(pa.string()), "=", values)
    else:
        text = _joined("=", values.cast(pa.string()), ";")
    return pc.if_else(values.is_valid(), text, "-")


def _lists(shape: pa.ListArray, values: pa.Array) -> pa.ListArray:
    """``values`` in lists of the lengths of ``shape``, null where that is null."""
    lengths = pc.list_value_length(shape)
    offsets = np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lengths.is_null())


def _digest(texts: pa.Array, valid: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Hashes as bytes and in hexadecimal, null where not ``valid``; equal texts are hashed once."""
    coded = texts.dictionary_encode()
    found = [hashlib.md5(t.encode()).digest() for t in coded.dictionary.to_pylist()]
    at = pc.if_else(valid, coded.indices, None)
    return pa.array(found, pa.binary()).take(at), pa.array([d.hex() for d in found], pa.string()).take(at)


def _marked(shape: pa.ListArray, hashes: pa.Array) -> pa.Array:
    """The hashes of each list as one text; a null hash is ``-``, a null list ``-`` without brackets."""
    held = pc.binary_join(_lists(shape, hashes.fill_null("-")), ",")
    return pc.if_else(shape.is_valid(), _joined("[", held, "]"), "-")


def _place(nodes: pa.StructArray, record: np.ndarray, path: pa.Array, parent: pa.Array, out: list[tuple]) -> tuple[pa.Array, pa.Array]:
    """Hashes of ``nodes``, children first; their places go to ``out``."""
    fields = dict(zip((f.name for f in nodes.type), nodes.flatten(), strict=True))
    link, answers = fields["linkId"], fields["answer"]
    values = answers.flatten()
    answer_hash, answer_hex = _digest(_canonical(values), values.is_valid())
    children, below = pa.nulls(len(nodes), pa.list_(pa.binary())), pa.array(["-"]).take(pa.array(np.zeros(len(nodes), np.int64)))
    if (items := fields.get("item")) is not None:
        lengths = pc.list_value_length(items).fill_null(0).to_numpy(zero_copy_only=False)
        up = np.repeat(np.arange(len(nodes)), lengths)
        ordinal = np.arange(len(up)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        child_path = _joined(path.take(pa.array(up)), ".", pa.array(ordinal).cast(pa.string()))
        child_hash, child_hex = _place(items.flatten(), record[up], child_path, link.fill_null("").take(pa.array(up)), out)
        children, below = _lists(items, child_hash), _marked(items, child_hex)
    text = _joined(pc.if_else(link.is_valid(), _joined("=", link), "-"), "\n", _marked(answers, answer_hex), "\n", below)
    whole, in_hex = _digest(text, nodes.is_valid())
    held = pa.StructArray.from_arrays([answer_hash, values], ["hash", "value"])
    out.append((record, path, parent, whole, link, _lists(answers, held), children))
    return whole, in_hex


def _shredded(key: str, items: str):
    """Places of Arrow batches of records (key, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, tops = batch.column(key), batch.column(items)
            lengths = pc.list_value_length(tops).fill_null(0).to_numpy(zero_copy_only=False)
            record = np.repeat(np.arange(len(keys)), lengths)
            ordinal = np.arange(len(record)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            out: list[tuple] = []
            _place(tops.flatten(), record, pa.array(ordinal).cast(pa.string()), pa.array([""]).take(pa.array(np.zeros(len(record), np.int64))), out)
            for at, *columns in out:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *columns], list(PLACE))

    return run


def shred(records: DataFrame, key: str = "rec_no", items: str = "item") -> FlatTables:
    """Flat tables of ``records``; nesting may be as deep as the schema says.

    Null items and answers keep their ordinal but are no objects; absent and empty arrays stay distinct. Hashing is
    done in Arrow batches, all values of a level at once, and needs no shuffle; the places are stored once, and identical objects are combined before each shuffle, so a subtree that
    a third of all records share costs one row a task.
    """
    value = records.schema[items].dataType.elementType["answer"].dataType.elementType
    held = T.ArrayType(T.StructType([T.StructField("hash", T.BinaryType()), T.StructField("value", value)]))
    kinds = [T.StringType(), T.StringType(), T.BinaryType(), T.StringType(), held, T.ArrayType(T.BinaryType())]
    schema = T.StructType([T.StructField("rec_no", records.schema[key].dataType), *(T.StructField(n, k) for n, k in zip(PLACE[1:], kinds, strict=True))])
    places = stored(records.select(key, items).mapInArrow(_shredded(key, items), schema), "merkle-places")
    heads = records.select(F.col(key).alias("rec_no"), F.when(F.col(items).isNotNull(), F.size(items)).alias("n_items"))
    return FlatTables(heads, places)


def answer_values(answers: DataFrame) -> DataFrame:
    """answer_hash, kind, val of the answers that hold a value; of several the first kind in the order below counts."""
    v = lambda name: F.col(f"value.{name}")
    code = F.when(F.length(v("valueCoding.code")) > 0, v("valueCoding.code"))
    kinds = [
        ("coding", F.coalesce(code, v("valueCoding.display"))),
        ("boolean", v("valueBoolean").cast("string")),
        ("decimal", two_decimals(v("valueDecimal"))),
        ("integer", v("valueInteger").cast("string")),
        ("date", v("valueDate")),
        ("dateTime", v("valueDateTime")),
        ("string", v("valueString")),
    ]
    first = F.coalesce(*(F.when(val.isNotNull(), F.struct(F.lit(k).alias("kind"), val.alias("val"))) for k, val in kinds))
    return answers.select("answer_hash", first.alias("a")).where("a is not null").select("answer_hash", "a.*")


def answer_rows(flat: FlatTables) -> DataFrame:
    """Every occurrence of an answer with a value: rec_no, item_path, answer_no, parent_link_id, link_id, kind, val.

    The distinct items get the values of their distinct answers (a broadcast if these are proven to be few, else a
    spread join) and are joined with their places last; an item that many places share is spread over tasks.
    """
    values = stored(answer_values(flat.distinct_answers()), "merkle-values")
    held = flat.distinct_items().select("item_hash", "link_id", F.posexplode("answers").alias("answer_no", "answer_hash")).where("answer_hash is not null")
    few = values.limit(SMALL + 1).count() <= SMALL
    valued = held.join(F.broadcast(values), "answer_hash") if few else spread_join(stored(held, "merkle-held"), values, ["answer_hash"], F.col("item_hash"))
    at = flat.places.where("item_hash is not null and size(answers) > 0").select("rec_no", "path", "parent_link_id", "item_hash")
    whole = spread_join(at, valued.drop("answer_hash"), ["item_hash"], F.struct("rec_no", "path"))
    return whole.select("rec_no", F.col("path").alias("item_path"), F.col("answer_no").cast("bigint").alias("answer_no"), "parent_link_id", F.coalesce("link_id", F.lit("")).alias("link_id"), "kind", "val")
