"""Chat formatting: records of any known layout, told by a fingerprint of their field paths, as marked turns.

A record is a JSON object. The paths of its fields, with array steps as ``[]``, are sorted and hashed; the hash names
the record's schema. A table of declarative mappings says for each known schema where the turns are, so a layout is
added by adding an entry, not code. Fields a layout may lack are listed as optional, and every choice of them has its own
fingerprint. Fields that no mapping reads (an id, a source) do not count: if the hash of all paths is unknown, those of
each mapping's own fields in the record are looked up, most fields first, ties in the order of the mappings. What stands
in place of a mapped field, above or below its path, is of another schema. A record of unknown schema gives no turns; its
row keeps the fingerprint of all its fields, so that a mapping can be added.

Template: a turn is ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash is put before every
backslash, every ``### `` and every ``</turn>``, and in roles before colons and line feeds too, so no text can end its
turn or open another, and removing one backslash before any character gives the text back.

Every turn is formatted by itself and knows its place, so a conversation of any length is never gathered: its text
is that of its turns in order. The loss mask of a turn is the span of its text, for assistant turns.

Defined results: null text is empty, null role is an empty role; records that are null or no JSON object have the
fingerprint of no fields; a row whose turn, role and text are all null, as that of a record of unknown schema, holds no
turn; turns are ordered by number, role and text; repeated rows are repeated turns; other columns and fields clash with
nothing, as only mapped paths are read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT, SYSTEM = "user", "assistant", "system"
OPEN, CLOSE = "### ", "</turn>"


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. Paths are dotted; ``[]`` steps into each element of an array.

    ``turns`` lists (role, path of the text) in order, a role beginning with ``$`` being the path of the role;
    with ``each``, role and text paths are relative to the elements of that array. ``place`` is the path of a turn
    number, for layouts of one turn per record.
    """

    name: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    place: str = ""
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict, hash=False)

    def paths(self) -> list[str]:
        prefix = f"{self.each}[]." if self.each else ""
        own = [prefix + p for role, text in self.turns for p in (role[1:] if role.startswith("$") else "", text) if p]
        return [*own, *([self.place] if self.place else [])]


NAMES = {"human": USER, "gpt": ASSISTANT, "prompter": USER, "bot": ASSISTANT, "model": ASSISTANT}

MAPPINGS = (
    Mapping("turn", (("$role", "text"),), place="turn"),
    Mapping("prompt_response", ((USER, "prompt"), (ASSISTANT, "response"))),
    Mapping("prompt_completion", ((USER, "prompt"), (ASSISTANT, "completion"))),
    Mapping("question_answer", ((USER, "question"), (ASSISTANT, "answer"))),
    Mapping("instruction", ((SYSTEM, "system"), (USER, "instruction"), (USER, "input"), (ASSISTANT, "output")), optional=("system", "input")),
    Mapping("messages", (("$role", "content"),), each="messages"),
    Mapping("conversations", (("$from", "value"),), each="conversations", roles=NAMES),
    Mapping("nested", (("$author.role", "content.text"),), each="messages"),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """The paths of all leaves; empty arrays and objects are leaves."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, f"{at}[]") for v in value))
    return {at} if at else set()


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def table_of(mappings: Iterable[Mapping] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by fingerprint, one entry for every choice of optional fields."""
    found = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for absent in combinations(m.optional, n):
                found[fingerprint(p for p in m.paths() if p not in absent)] = m
    return found


def _in_the_way(path: str, mapped: str) -> bool:
    """Whether a leaf at ``path`` lies above or below a mapped field, so that one of them is not what it seems."""
    short, long = sorted((path, mapped), key=len)
    return short != long and long.startswith(short) and long[len(short)] in ".["


def mapping_of(paths: set[str], known: dict[str, Mapping], mappings: Iterable[Mapping]) -> tuple[str, Mapping | None]:
    """The schema of a record with these paths, and its mapping if there is one."""
    schema = fingerprint(paths)
    if schema in known:
        return schema, known[schema]
    best: tuple[int, str, Mapping | None] = (0, schema, None)
    for m in mappings:
        own = paths.intersection(m.paths())
        chosen = fingerprint(own)
        if len(own) > best[0] and known.get(chosen) == m and not any(_in_the_way(p, q) for p in paths for q in m.paths()):
            best = len(own), chosen, m
    return best[1:]


def _at(value: object, path: str) -> object:
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, mapping: Mapping) -> list[tuple[int, str, str]]:
    """Canonical turns of a record: number, role, text. Fields a layout may leave out give no turn."""
    elements = record.get(mapping.each) if mapping.each else [record]
    found = []
    for element in elements:
        for role, path in mapping.turns:
            if path in mapping.optional and _at(element, path) in (None, ""):
                continue
            name = _text(_at(element, role[1:])) if role.startswith("$") else role
            place = _at(record, mapping.place) if mapping.place else len(found)
            found.append((place, mapping.roles.get(name, name), _text(_at(element, path))))
    return found


def _parsed(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        value = {}
    return value if isinstance(value, dict) else {}


def _canonical(mappings: tuple[Mapping, ...]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table_of(mappings)
        for batch in batches:
            rows = []
            for conv, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = _parsed(record)
                schema, mapping = mapping_of(field_paths(value), known, mappings)
                if mapping is None:
                    rows.append((conv, schema, None, None, None))
                else:
                    rows.extend((conv, schema, *turn) for turn in turns_of(value, mapping))
            kinds = [batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["conv_id", "schema", "turn", "role", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names)

    return run


def canonical_turns(records: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Turns (conv_id, schema, turn, role, text) of JSON records; one row without turn for records of unknown schema."""
    kind = records.schema[id_col].dataType.simpleString()
    return records.select(id_col, record_col).mapInArrow(
        _canonical(mappings), f"conv_id {kind}, schema string, turn long, role string, text string"
    )


def _escaped(text: Column, more: str = "") -> Column:
    return F.regexp_replace(text, rf"(\\|### |</turn>{more})", r"\\$1")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with role and text made non-null, ``formatted`` (empty for a row without turn), and the loss span in it
    (from, to; null without loss).
    """
    no_turn = F.col("turn").isNull() & F.col("role").isNull() & F.col("text").isNull()
    given = {"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit("")), "formatted": no_turn}
    known = turns.withColumns(given)
    head = F.concat(F.lit(OPEN), _escaped(F.col("role"), r"|:|\n"), F.lit(": "))
    body = _escaped(F.col("text"))
    trained = F.col("role") == ASSISTANT
    return known.withColumns(
        {
            "formatted": F.when(F.col("formatted"), "").otherwise(F.concat(head, body, F.lit(CLOSE + "\n"))),
            "loss_from": F.when(trained, F.char_length(head)),
            "loss_to": F.when(trained, F.char_length(head) + F.char_length(body)),
        }
    )


_PLAIN = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns, read back."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((_PLAIN.sub(r"\1", m[1]), _PLAIN.sub(r"\1", m[2])))
        at = m.end()
    return found


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn to one row per conversation; holds digests, not texts."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    open_: list = []

    def closed(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [dict(zip(names, (c, n, t.hexdigest(), k, l.hexdigest(), f))) for c, n, t, k, l, f in rows],
            pa.schema(list(zip(names, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]))),
        )

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        done = []
        for conv, formatted, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_ or open_[0] != conv:
                if open_:
                    done.append(open_)
                open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read_turns(formatted):
                open_[1] += 1
                open_[2].update(f"{role}\n{text}\n".encode())
            if lo is not None:
                loss = _PLAIN.sub(r"\1", formatted[lo:hi])
                open_[3] += len(loss)
                open_[4].update(loss.encode())
            open_[5] += len(formatted)
        if done:
            yield closed(done)
    if open_:
        yield closed([open_])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted turns.

    A SHA-256 digest is made in order, so a conversation's turns pass through one task, but as a stream: sorted on
    disk if need be, one Arrow batch in memory.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "turn", "role", "text", "formatted", "loss_from", "loss_to")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(
        _digests,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
