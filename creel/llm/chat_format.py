"""Chat formatting: any layout of prompts, instructions or messages as canonical turns, and one template.

The layout of a table is its nested field paths. Their hash selects a declarative
mapping to turns (conversation, turn, role, text). Turns are formatted one by one,
so a conversation is the text of its turns in order, however long it is. Control
strings inside texts are broken by an escape that can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

BEGIN, END = "<s>[", "</s>"
ROLE_END = "]\n"
# fixed values: strings that steer a model and must not stand in a text as they are
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"


def paths(kind: DataType, at: str = "") -> Iterator[str]:
    """All nested field paths of a type, list elements as [] and map values as {}."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield from paths(f.dataType, f"{at}.{f.name.lower()}" if at else f.name.lower())
    elif isinstance(kind, ArrayType):
        yield from paths(kind.elementType, f"{at}[]")
    elif isinstance(kind, MapType):
        yield from paths(kind.valueType, f"{at}{{}}")
    else:
        yield at


def fingerprint(fields: Iterator[str] | list[str]) -> str:
    """Hash of field paths, the same in any order."""
    return hashlib.sha256("\n".join(sorted(fields)).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), text.cast("string").alias("text"))


def _listed(field: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.col(field), lambda m: _turn(m[role], m[text]))


def _given(*turns: tuple[str, str | tuple[str, str]]) -> Callable[[], Column]:
    """Turns from columns; a turn whose column is null is left out, two columns are joined by a blank line."""

    def build() -> Column:
        made = []
        for role, field in turns:
            text = F.col(field) if isinstance(field, str) else F.concat(F.col(field[0]), F.when(F.coalesce(F.col(field[1]), F.lit("")) != "", F.concat(F.lit("\n\n"), F.col(field[1]))).otherwise(""))
            made.append(F.when(text.isNotNull(), _turn(role, text)))
        return F.filter(F.array(*made), lambda t: t.isNotNull())

    return build


#: For each layout its field paths, beside the conversation's id, and the turns they make.
LAYOUTS: dict[str, tuple[list[str], Callable[[], Column] | None]] = {
    "turn rows": (["turn", "role", "text"], None),
    "messages": (["messages[].role", "messages[].content"], _listed("messages", "role", "content")),
    "from and value": (["conversations[].from", "conversations[].value"], _listed("conversations", "from", "value")),
    "prompt and response": (["prompt", "response"], _given(("user", "prompt"), (ASSISTANT, "response"))),
    "prompt and completion": (["prompt", "completion"], _given(("user", "prompt"), (ASSISTANT, "completion"))),
    "question and answer": (["question", "answer"], _given(("user", "question"), (ASSISTANT, "answer"))),
    "instruction": (["instruction", "output"], _given(("user", "instruction"), (ASSISTANT, "output"))),
    "instruction and input": (["instruction", "input", "output"], _given(("user", ("instruction", "input")), (ASSISTANT, "output"))),
    "system and prompt": (["system", "prompt", "response"], _given(("system", "system"), ("user", "prompt"), (ASSISTANT, "response"))),
}
MAPPINGS = {fingerprint(fields): (name, fields, turns) for name, (fields, turns) in LAYOUTS.items()}
# fixed values: other names of the roles
ROLES = {"human": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def layout(df: DataFrame, id_col: str) -> tuple[str, list[str], Callable[[], Column] | None]:
    """The mapping whose fields' hash is that of the table's, or of the largest part of them that has a mapping."""
    have = [p for p in paths(df.schema) if p != id_col.lower()]
    exact = MAPPINGS.get(fingerprint(have))
    if exact:
        return exact
    held = [m for m in MAPPINGS.values() if fingerprint([p for p in have if p in m[1]]) == fingerprint(m[1])]
    if not held:
        raise ValueError(f"no mapping for the fields {sorted(have)}")
    return max(held, key=lambda m: (len(m[1]), m[0]))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns of any known layout: conv_id, turn, role, text.

    Fields that the mapping does not name are ignored. A null text is empty, a null
    role is `unknown`, other names of roles are replaced only in layouts that are not
    rows by turn already. A null list has no turns.
    """
    _, _, build = layout(df, id_col)
    if build is None:
        return df.select(F.col(id_col).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = df.select(F.col(id_col).alias("conv_id"), F.posexplode(build()).alias("turn", "t"))
    role = F.coalesce(F.col("t.role"), F.lit("unknown"))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(names[F.lower(role)], role).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def escaped(text: Column) -> Column:
    """Double every backslash and break every control string after its first sign by a backslash and a colon."""
    signs = "|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, signs, "".join(f"${i + 1}" for i in range(len(CONTROL))) + "\\\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\:])", lambda m: "\\" if m[1] == "\\" else "", text)


def formatted(turns: DataFrame) -> DataFrame:
    """Add to every turn its part of the conversation's formatted text and the place of the loss within that part.

    Columns: formatted, loss_start and loss_end (0 and 0 for turns without loss),
    counted in characters. Loss is on what an assistant says, without the marks.
    """
    # a role stands before a line break and a bracket, so it must not hold the like
    role = F.regexp_replace(escaped(F.col("role")), "([\\]\\n])", "\\\\:$1\\\\:")
    # nor make a control string together with the brackets around it
    role = F.when(F.concat(F.lit("["), role, F.lit("]")).isin(*CONTROL), F.concat(F.lit("\\:"), role)).otherwise(role)
    head = F.concat(F.lit(BEGIN), role, F.lit(ROLE_END))
    text = escaped(F.col("text"))
    said = F.col("role") == ASSISTANT
    return (
        turns.withColumn("formatted", F.concat(head, text, F.lit(END)))
        .withColumn("loss_start", F.when(said, F.length(head)).otherwise(0))
        .withColumn("loss_end", F.when(said, F.length(head) + F.length(text)).otherwise(0))
    )


PART = re.compile(r"<s>\[((?:[^\]\n\\]|\\[\\:]|(?<=\\:)[\]\n])*)\]\n(.*?)</s>", re.S)


def read_back(part: str) -> list[tuple[str, str]]:
    """Role and text of every turn in a formatted text."""
    out, at = [], 0
    while at < len(part):
        m = PART.match(part, at)
        if m is None:
            raise ValueError("this is not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digests(parts: DataFrame) -> DataFrame:
    """Digests of every conversation, read back from its formatted parts.

    The parts of a conversation stream through one task in order; only hashes and
    counts are held, whatever its length. Rows of equal turn are ordered by role and text.
    """
    id_type = parts.schema["conv_id"].dataType.simpleString()
    rows = parts.select("conv_id", "turn", "formatted", "loss_start", "loss_end", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, begun = None, [], False
        turns = said = loss = None
        counts = [0, 0, 0]

        def done() -> None:
            found.append((now, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]))

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, part, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        done()
                    now, begun = conv, True
                    turns, loss, counts = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                for role, text in read_back(part):
                    turns.update(f"{role}\n{text}\n".encode())
                    counts[0] += 1
                said = unescape(part[start:end])
                loss.update(said.encode())
                counts[1] += len(said)
                counts[2] += len(part)
            if found:
                yield batch_of(found, kind)
                found.clear()
        if begun:
            done()
            yield batch_of(found, kind)

    def batch_of(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        ids, n, a, chars, b, size = zip(*found, strict=True)
        return pa.record_batch([pa.array(ids, kind), pa.array(n, pa.int64()), pa.array(a), pa.array(chars, pa.int64()), pa.array(b), pa.array(size, pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return rows.mapInArrow(stream, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_format(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Formatted parts of every turn of a table in any known layout.

    Returns conv_id, turn, role, text, formatted, loss_start and loss_end; the parts of
    a conversation in order of turn are its formatted text. Null texts are empty, turns
    that are repeated stay, rows with a null id are one conversation without an id, an empty
    table gives no rows, and fields outside the mapping are ignored.
    """
    return formatted(canonical_turns(df, id_col))
