"""Conversations as one marked text each, with the part of it that a model should learn from, and back.

A template says how turns of a role begin and end, which role may follow which, and whose words count for the loss. A
finite-state machine, whose state is the role of the turn before, checks the order of turns. The text is written as segments
(marks and turns in order), never as one string, so a conversation may have any number of turns.

Marks inside a turn's text are escaped: a backslash is doubled and one is put after the first character of every mark, so
that text holds no mark and no information is lost. ``read_turns`` needs the text alone: it finds marks and takes the escapes out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timeline_lake.llm.shared import given, new_folder
from timeline_lake.operators.blocks import row_numbers

START = ""
ESCAPE = "\\"


@dataclass(frozen=True)
class Turn:
    """How turns of a role are written. Their closing mark counts for the loss only if ``loss`` and ``loss_on_close``."""

    opening: str
    closing: str
    loss: bool = False
    loss_on_close: bool = False


@dataclass(frozen=True)
class Template:
    """Marks per role, and the machine over roles.

    ``follows[role]`` are the roles that may come after ``role`` (``""``: at the start), ``ends`` those a conversation may end
    with. A role that is not in ``turns`` is written as ``other``, with its name in front of ``name_end``, and may follow
    nothing. Marks must not overlap, so that every one of them is found wherever it stands.
    """

    turns: dict[str, Turn]
    follows: dict[str, tuple[str, ...]]
    ends: tuple[str, ...]
    begin: str = "<s>"
    other: Turn = field(default_factory=lambda: Turn("[TURN]", "[/TURN]"))
    name_end: str = "[AS]"

    def __post_init__(self) -> None:
        marks = self.marks()
        if any(not m or ESCAPE in m or len(m) < 2 for m in marks):
            raise ValueError("a mark has at least two characters and no backslash")
        openings = [self.begin, self.other.opening, *(t.opening for t in self.turns.values())]
        closings = {self.other.closing, *(t.closing for t in self.turns.values())}
        if len(set(openings)) < len(openings) or closings & set(openings) or self.name_end in closings | set(openings):
            raise ValueError("opening marks must differ from one another and from closing ones")
        for a, b in product(marks, marks):
            if a != b and a in b or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b))) if a[-n:] == b[:n]):
                raise ValueError(f"the marks {a} and {b} overlap")

    def marks(self) -> list[str]:
        of_turns = [m for t in (*self.turns.values(), self.other) for m in (t.opening, t.closing)]
        return list(dict.fromkeys([self.begin, self.name_end, *of_turns]))

    def pattern(self) -> str:
        return "|".join(map(re.escape, self.marks()))


#: Instructions in brackets; the assistant's words, not its end mark, count for the loss.
INSTRUCT = Template(
    turns={"system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[OUT]", "</s>", loss=True)},
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant", "user"),
)


def escaped(text: Column, template: Template) -> Column:
    # In a replacement two backslashes stand for one.
    text = F.regexp_replace(text, r"\\", r"\\\\")
    # No mark overlaps another, so each occurrence is taken by itself.
    return F.regexp_replace(text, f"(?={template.pattern()})([\\s\\S])", r"$1\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the turns of every conversation as 0, 1, 2, …, in order of turn, role, text.

    Null roles and texts are empty; a null turn comes first; rows without a conv_id are one conversation. No conversation has
    to fit in one task: turns are dealt by blocks of their number.
    """
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    # Turns are mostly numbered closely, so a block of numbers holds few rows.
    block = F.coalesce(F.floor(F.col("turn") / F.lit(1 << 16)).cast("long"), F.lit(-(1 << 62)))
    return row_numbers(rows, ["conv_id"], ["turn", "role", "text"], block, "place").select("conv_id", "place", "role", "text")


def check_order(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, n_misplaced, valid: whether the machine accepts the roles of each conversation (see ``numbered_turns``).

    A turn is misplaced if its role may not follow the one before. A turn meets the one before it by its place, one row for
    one row, so a long conversation is checked by many tasks.
    """
    before = turns.select(F.col("conv_id").alias("_conv"), (F.col("place") + 1).alias("_next"), F.col("role").alias("_before"))
    joined = turns.join(before, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_next")), "left")
    moves = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, roles in template.follows.items() for b in roles]
    allowed = F.array_contains(F.array(*moves), F.struct(F.coalesce("_before", F.lit(START)).alias("a"), F.col("role").alias("b")))
    # The role "" is not the start.
    allowed = allowed & ((F.col("place") == 0) | (F.col("_before") != START))
    sums = joined.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum((~allowed).cast("long")).alias("n_misplaced"), F.max_by("role", "place").alias("_last")
    )
    valid = (F.col("n_misplaced") == 0) & F.col("_last").isin(*template.ends)
    return sums.select("conv_id", "n_turns", "n_misplaced", valid.alias("valid"))


def segments(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, place, piece, segment, loss: the text of each conversation in pieces, in order of place and piece.

    Joined in that order the segments are the conversation's text; ``loss`` says which of them count.
    """

    def lit(mark: str, loss: bool = False) -> Column:
        return F.struct(F.lit(mark).alias("segment"), F.lit(loss).alias("loss"))

    def written(text: Column, loss: bool = False) -> Column:
        return F.struct(escaped(text, template).alias("segment"), F.lit(loss).alias("loss"))

    def turn(shape: Turn, *name: Column) -> Column:
        return F.array(lit(shape.opening), *name, written(F.col("text"), shape.loss), lit(shape.closing, shape.loss and shape.loss_on_close))

    pieces = turn(template.other, written(F.col("role")), lit(template.name_end))
    for role, shape in template.turns.items():
        pieces = F.when(F.col("role") == role, turn(shape)).otherwise(pieces)
    pieces = F.concat(F.when(F.col("place") == 0, F.array(lit(template.begin))).otherwise(F.array().cast("array<struct<segment:string,loss:boolean>>")), pieces)
    return turns.select("conv_id", "place", F.posexplode(pieces).alias("piece", "_s")).select("conv_id", "place", "piece", "_s.segment", "_s.loss").filter("segment <> ''")


class Reader:
    """Reads one conversation's text, segment by segment, and adds up digests of what it finds. It keeps one turn at most."""

    def __init__(self, template: Template):
        self.template = template
        self.mark = re.compile(f"({template.pattern()})")
        self.roles = {t.opening: role for role, t in template.turns.items()}
        self.closing = {role: t.closing for role, t in template.turns.items()}
        self.n_turns = self.chars = self.loss_chars = 0
        self.turns_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()
        self.expected, self.role, self.text, self.named = "begin", None, [], False

    def add(self, segment: str, loss: bool) -> None:
        self.chars += len(segment)
        if loss:
            kept = unescaped("".join(p for i, p in enumerate(self.mark.split(segment)) if i % 2 == 0))
            self.loss_chars += len(kept)
            self.loss_digest.update(kept.encode("utf-8"))
        for i, part in enumerate(self.mark.split(segment)):
            if i % 2:
                self._take(part)
            elif part:
                if self.expected not in ("name", "text"):
                    raise ValueError("text outside of turns")
                self.text.append(part)

    def _take(self, mark: str) -> None:
        template = self.template
        if self.expected == "begin" and mark == template.begin:
            self.expected = "turn"
        elif self.expected == "turn" and mark in self.roles:
            self.role, self.expected = self.roles[mark], "text"
        elif self.expected == "turn" and mark == template.other.opening:
            self.role, self.expected = None, "name"
        elif self.expected == "name" and mark == template.name_end:
            self.role, self.text, self.expected, self.named = unescaped("".join(self.text)), [], "text", True
        elif self.expected == "text" and mark == (template.other.closing if self.named else self.closing[self.role]):
            turn = f"{self.role}\n{unescaped(''.join(self.text))}\n"
            self.turns_digest.update(turn.encode("utf-8"))
            self.n_turns += 1
            self.role, self.text, self.expected, self.named = None, [], "turn", False
        else:
            raise ValueError(f"{mark} where {self.expected} was expected")

    def row(self) -> tuple:
        if self.expected != "turn":
            raise ValueError("a conversation ends within a turn")
        return self.n_turns, self.turns_digest.hexdigest(), self.loss_chars, self.loss_digest.hexdigest(), self.chars


def read_digests(pieces: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from written segments.

    A digest takes a conversation's text from its first byte to its last, so each conversation is read in order by one task,
    segment after segment; the task keeps one turn and two digests, however long the conversation is.
    """

    def read(batches):
        now, reader, begun, out = None, None, False, []
        for batch in batches:
            for conv, segment, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != now:
                    if begun:
                        out.append((now, *reader.row()))
                    now, reader, begun = conv, Reader(template), True
                reader.add(segment, loss)
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if begun:
            out.append((now, *reader.row()))
        if out:
            yield _batch(out)

    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place", "piece").select("conv_id", "segment", "loss")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def write_conversations(conversations: DataFrame, path: str, template: Template = INSTRUCT) -> tuple[DataFrame, DataFrame]:
    """Write the segments of all conversations to ``path`` as Parquet and return (segments read back, order check)."""
    spark = conversations.sparkSession
    turns = numbered_turns(conversations)
    segments(turns, template).write.parquet(path)
    return spark.read.parquet(path), check_order(turns.select("conv_id", "place", "role"), template)


def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given_rows = given(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    sample = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", sample), (-1, 1, "assistant", sample)], "conv_id long, turn long, role string, text string")
    written, order = write_conversations(given_rows.unionByName(added), new_folder(spark, "chat"))
    checked = order.select(F.col("conv_id").alias("_conv"), "n_misplaced", "valid")
    digests = read_digests(written)
    return digests.join(checked, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


_MARKS_SQL = "t"
for _mark in INSTRUCT.marks():
    _MARKS_SQL = f"replace({_MARKS_SQL}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

OP12_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w AS place, lead(role) OVER w IS NULL AS final
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
escaped AS (
  SELECT *, length({_MARKS_SQL.replace("(t,", "(replace(text, chr(92), chr(92) || chr(92)),")}) AS text_chars,
         length({_MARKS_SQL.replace("(t,", "(replace(role, chr(92), chr(92) || chr(92)),")}) AS role_chars,
         (before IS NULL AND place = 1 AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
           OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') AS allowed
  FROM placed)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(text_chars + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
                                       ELSE 17 + role_chars END))::BIGINT AS formatted_chars,
       sum((NOT coalesce(allowed, false))::INT)::BIGINT AS n_misplaced,
       sum((NOT coalesce(allowed, false))::INT) = 0 AND last(role ORDER BY place) IN ('assistant', 'user') AS valid
FROM escaped GROUP BY conv_id
"""
