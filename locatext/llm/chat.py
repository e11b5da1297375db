"""Chat formatting with a grammar round trip.

    output := turn*
    turn   := "<turn>" LF "### " role ":" LF text LF "</turn>" LF

Inside role and text a backslash escapes the next character. A turn is first
rendered as it is and read back with the deterministic parser below; if the parser
stops early, fails or recovers something else, the places where its reading left
the source are escaped and the turn is rendered again, until both are identical.
Rows of a conversation meet in turn order in one task but are handled one turn at
a time: memory is bounded by the longest turn, not by the conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locatext.llm.arrays import bound_batches

OPEN, HEAD, COLON, CLOSE = "<turn>\n", "### ", ":\n", "\n</turn>\n"
#: What the parser gives a meaning to, longest first: only these can conflict.
_ROLE_CONTROL = re.compile(r"\\|:|\n")
_TEXT_CONTROL = re.compile(r"\\|</turn>|<turn>|### ")


class Unreadable(ValueError):
    pass


def _read(rendered: str, at: int, stop: str) -> tuple[str, int]:
    """Unescaped content from ``at`` up to the first unescaped ``stop``, and the end."""
    out, n = [], len(rendered)
    end = rendered.find(stop, at)
    while end >= 0:
        back = rendered.find("\\", at, end)
        if back < 0:
            out.append(rendered[at:end])
            return "".join(out), end + len(stop)
        if back + 1 >= n:
            raise Unreadable("nothing after a backslash")
        out += [rendered[at:back], rendered[back + 1]]
        at = back + 2
        if at > end:  # that stop was escaped
            end = rendered.find(stop, at)
    raise Unreadable(f"no {stop!r}")


def parse_turn(rendered: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role, text, start and end of the text as rendered, end of the turn."""
    if not rendered.startswith(OPEN + HEAD, at):
        raise Unreadable("no turn here")
    role, start = _read(rendered, at + len(OPEN + HEAD), COLON)
    text, end = _read(rendered, start, CLOSE)
    return role, text, start, end - len(CLOSE), end


def parse(rendered: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(rendered):
        role, text, _, _, at = parse_turn(rendered, at)
        turns.append((role, text))
    return turns


def _escaped(content: str, control: re.Pattern[str], times: int) -> str:
    """Escape the first ``times`` conflicting places."""
    return control.sub(lambda m: "\\" + m[0], content, count=times) if times else content


def render_turn(role: str, text: str) -> str:
    """Rendered turn that reads back to exactly (role, text) and ends where it ends.
    The last attempt escapes every control string, which cannot conflict."""
    everywhere = len(role) + len(text) + 1
    for of_role, of_text in ((0, 0), (0, everywhere), (everywhere, everywhere)):
        rendered = OPEN + HEAD + _escaped(role, _ROLE_CONTROL, of_role) + COLON + _escaped(text, _TEXT_CONTROL, of_text) + CLOSE
        try:
            got_role, got_text, _, _, end = parse_turn(rendered)
        except Unreadable:
            continue
        if (got_role, got_text, end) == (role, text, len(rendered)):
            return rendered
    raise Unreadable("a fully escaped turn did not read back")


OUT = "k {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(turns: DataFrame, keep_text: bool = False, loss_role: str = "assistant") -> DataFrame:
    """Format ``turns`` (conv_id, turn, role, text); one row per conversation with
    figures read back from the output: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars and, with ``keep_text``, ``formatted`` and ``loss_spans`` (array of
    start and end in it). Null role or text is empty; a null turn comes first; rows of
    equal turn are ordered by role and text, repeated rows are repeated turns; a null
    conv_id is a conversation of its own. Other columns are not read."""
    src = bound_batches(turns).select(F.col("conv_id").alias("k"), F.col("turn").alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = src.schema["k"].dataType.simpleString()
    more = ", formatted string, loss_spans array<struct<start:long,end:long>>" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        now: list | None = None  # key, turns, hash, loss chars, loss hash, formatted chars, parts, spans

        def flush() -> pa.RecordBatch:
            rows = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5], "".join(r[6]), r[7]] for r in done]
            done.clear()
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))][: 8 if keep_text else 6]
            names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "formatted", "loss_spans"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names[: len(kinds)])

        for batch in batches:
            key_type = batch.schema.field("k").type
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("k", "role", "text")), strict=True):
                if now is None or now[0] != key:
                    if now is not None:
                        done.append(now)
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, [], []]
                rendered = render_turn(role, text)
                role, text, start, end, _ = parse_turn(rendered)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if role == loss_role:
                    now[3] += len(text)
                    now[4].update(text.encode())
                    if keep_text:
                        now[7].append({"start": now[5] + start, "end": now[5] + end})
                now[5] += len(rendered)
                if keep_text:
                    now[6].append(rendered)
            if done:
                yield flush()
        if now is not None:
            done.append(now)
            yield flush()

    dealt = src.repartition("k").sortWithinPartitions("k", "n", "role", "text")
    return dealt.mapInArrow(run, OUT.format(kind) + more).withColumnRenamed("k", "conv_id")
