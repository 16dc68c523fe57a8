"""Chat formatting by schema fingerprints.

The nested field paths of a JSON record, sorted and hashed, select a declarative mapping (which array holds the turns, which
fields hold role and text, or which fields of the record are which role's turn); the mapping turns the record into canonical
turns (role, text). All of it is built-in SQL on variants: no Python sees a record.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

ROLES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "chatgpt": "assistant", "agent": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: path of an array of records with fields role and text. Or parts: (path, role) pairs, one turn each, in order,
    texts of neighbours with one role joined by a blank line. history: path of an array of [user, assistant] pairs that comes first. optional: paths that a
    record may have or lack."""

    name: str
    turns: str = ""
    role: str = "role"
    text: str = "content"
    parts: tuple[tuple[str, str], ...] = ()
    history: str = ""
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        at = [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"] if self.turns else []
        return at + [p for p, _ in self.parts] + ([f"{self.history}[][]"] if self.history else [])


MAPPINGS = (
    Mapping("messages", turns="messages", optional=("id", "model", "source", "messages[].role")),
    Mapping("conversations", turns="conversations", role="from", text="value", optional=("id", "system", "conversations[].from")),
    Mapping("dialogue", turns="dialog.turns", role="speaker", text="utterance", optional=("dialog.id", "id", "dialog.turns[].speaker")),
    Mapping("prompt", parts=(("prompt", "user"), ("completion", "assistant")), optional=("id",)),
    Mapping("response", parts=(("prompt", "user"), ("response", "assistant")), optional=("id", "system")),
    Mapping("question", parts=(("question", "user"), ("answer", "assistant")), optional=("id",)),
    Mapping("instruction", parts=(("instruction", "user"), ("input", "user"), ("output", "assistant")), history="history", optional=("id", "input", "system", "history[][]")),
)


def spelled(paths: list[str]) -> str:
    """Field paths as one nested text with the names in order, as of_record spells those of a record."""
    tree: dict = {}
    for p in paths:
        node = tree
        for step in p.replace("[]", ".[]").split("."):
            node = node.setdefault(step, {})

    def text(node: dict) -> str:
        if not node:
            return ""
        if "[]" in node:
            return f"ARRAY<{text(node['[]'])}>"
        return "OBJECT<" + ", ".join(k + (f": {t}" if (t := text(v)) else "") for k, v in sorted(node.items())) + ">"

    return text(tree)


def layouts(m: Mapping) -> list[list[str]]:
    """The field paths of all layouts that the mapping takes."""
    must = [p for p in m.paths() if p not in m.optional]
    return [must + list(extra) for k in range(len(m.optional) + 1) for extra in combinations(m.optional, k)]


@cache
def _hash(text: str) -> int:
    """Spark's xxhash64 (seed 42) of a text."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


SCALAR = "(?:VOID|STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\\([0-9,]+\\)|DATE|TIMESTAMP(?:_NTZ)?|BINARY|UUID)"


def of_record(record: Column) -> Column:
    """The nested field paths of a JSON text, names in order, types of scalars left out (a null is a scalar); all elements of an
    array count together, an array of unlike elements as VARIANT. Null for what isn't JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(F.regexp_replace(schema, f": {SCALAR}(?=[,>])", ""), f"ARRAY<{SCALAR}>", "ARRAY<>")


def _turn(role: Column, text: Column) -> Column:
    plain = F.lower(F.trim(role))
    known = F.create_map([F.lit(x) for kv in ROLES.items() for x in kv])
    return F.struct(F.coalesce(known[plain], plain, F.lit("user")).alias("role"), text.alias("text"))


def _turns(m: Mapping, parsed: Column) -> Column:
    def at(path: str) -> Column:
        c = parsed
        for step in path.split("."):
            c = c[step]
        return c

    if m.turns:
        return F.transform(at(m.turns), lambda t: _turn(t[m.role], t[m.text]))
    said = []
    for role in dict.fromkeys(r for _, r in m.parts):
        texts = F.filter(F.array(*(at(p) for p, r in m.parts if r == role)), lambda t: t.isNotNull() & (t != ""))
        said.append(_turn(F.lit(role), F.when(F.size(texts) > 0, F.array_join(texts, "\n\n"))))
    turns = F.array(*said)
    if m.history:
        pairs = F.coalesce(at(m.history), F.array().cast("array<array<string>>"))
        past = F.flatten(F.transform(pairs, lambda p: F.transform(p, lambda t, i: _turn(F.when(i % 2 == 0, "user").otherwise("assistant"), t))))
        turns = F.concat(past, turns)
    return turns


def _schema(mappings: tuple[Mapping, ...]) -> str:
    tree: dict = {}
    for m in mappings:
        for p in m.paths():
            node = tree
            for step in p.replace("[]", ".[]").split("."):
                node = node.setdefault(step, {})

    def ddl(node: dict) -> str:
        if not node:
            return "string"
        if "[]" in node:
            return f"array<{ddl(node['[]'])}>"
        return "struct<" + ",".join(f"`{k}`:{ddl(v)}" for k, v in node.items()) + ">"

    return ddl(tree)


def _once(value: Column, then) -> Column:
    """then(value) with value computed once a row: a lambda's argument isn't copied into each place that uses it, as an expression is."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def canonical(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All columns of records and fingerprint, mapping (name), turns (array of role, text), with underscores after a name that records has.

    A layout that no mapping knows has null mapping and turns; a null record or what isn't JSON has a null fingerprint too.
    Turns without text (null) are left out, empty texts of an array of turns stay, and a part that is empty says nothing.
    Roles are lower-cased and known synonyms mapped; a missing role is user, in some turns or in all. Long texts stay whole;
    turns keep their order, equal ones too. Repeated rows stay; an empty table stays empty.
    """
    said, print_, name, turns = (free_name(records, x) for x in ("said", "fingerprint", "mapping", "turns"))
    named = F.create_map(*(x for h, m in {_hash(spelled(p)): m.name for m in mappings for p in layouts(m)}.items() for x in (F.lit(h), F.lit(m))))
    kind = "array<struct<role:string,text:string>>"

    def turns_of(name_: Column) -> Column:
        def each(parsed: Column) -> Column:
            out = F.lit(None).cast(kind)
            for m in mappings:
                out = F.when(name_ == m.name, F.filter(_turns(m, parsed), lambda t: t["text"].isNotNull())).otherwise(out)
            return out

        return F.when(name_.isNotNull(), _once(F.from_json(record_col, _schema(mappings)), each))

    def found(hash_: Column) -> Column:
        return _once(named[hash_], lambda n: F.struct(hash_.alias("fingerprint"), n.alias("mapping"), turns_of(n).cast(kind).alias("turns")))

    one = _once(of_record(F.col(record_col)), lambda s: _once(F.when(s.isNotNull(), F.xxhash64(s)), found))
    return records.withColumn(said, one).select(*records.columns, *(F.col(f"{said}.{f}").alias(n) for f, n in (("fingerprint", print_), ("mapping", name), ("turns", turns))))


def records(conversations: DataFrame) -> DataFrame:
    """conv_id, record: each conversation as JSON, in a layout that its id's hash and its shape select; the other way round than canonical().

    Turns are in the order of turn, then role, then text, and repeated rows are turns of their own; those without text are left
    out, and with them conversations that have no others. A null conv_id is a conversation; a null role is left out of its
    record, so that canonical() reads it as user; texts of any length are whole; an empty table gives an empty result.
    """
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    df = conversations.where("text is not null").groupBy("conv_id").agg(said.alias("said"))
    s, n = F.col("said"), F.size("said")
    pairs = F.forall(F.sequence(F.lit(0), n - 1), lambda i: F.get(s, i)["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")) & (n % 2 == 0)
    full = F.forall(s, lambda t: t["text"] != "")
    text = lambda i: F.get(s, i)["text"]
    each = lambda role, text_: F.transform(s, lambda t: F.struct(t["role"].alias(role), t["text"].alias(text_)))
    past = F.transform(F.sequence(F.lit(0), n - 4, F.lit(2)), lambda i: F.array(text(i), text(i + 1)))
    k = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    one, more = pairs & full & (n == 2), pairs & full & (n > 2)
    record = (
        F.when(one & (k == 0), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(one & (k == 1), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(one & (k == 2), F.to_json(F.struct(text(0).alias("question"), text(1).alias("answer"))))
        .when(one & (k == 3), F.to_json(F.struct(text(0).alias("instruction"), F.lit("").alias("input"), text(1).alias("output"))))
        .when(more & (k < 2), F.to_json(F.struct(text(n - 2).alias("instruction"), text(n - 1).alias("output"), past.alias("history"))))
        .when(k < 3, F.to_json(F.struct(F.struct(each("speaker", "utterance").alias("turns")).alias("dialog"))))
        .when(k < 5, F.to_json(F.struct(each("from", "value").alias("conversations"))))
        .otherwise(F.to_json(F.struct(F.col("conv_id").alias("id"), each("role", "content").alias("messages"))))
    )
    return df.select("conv_id", record.alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    told = canonical(records(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return told.select("conv_id", F.posexplode("turns")).select("conv_id", F.col("pos").alias("turn"), "col.role", "col.text")


SQL = """
select conv_id, (row_number() over (partition by conv_id order by turn nulls first, role nulls first, text) - 1)::int as turn, coalesce(lower(trim(role)), 'user') as role, text
from conversations where text is not null
"""
