"""Loading delimited lines of which some are broken (problem 5).

A line without faults is read at no cost. Any other is parsed at the least cost:
quotes and delimiters are inserted or deleted, and ids that are none typed anew,
by dynamic programming. The edits of the cheapest parse state the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ID = 4294967295
FIELDS = 4
_DIGITS = re.compile(r"[0-9]+")
_FIELD = re.compile(r'(?:"([^"]*(?:""[^"]*)*)"|([^"\t]*))(\t|\Z)')
_SYMBOL = re.compile(r'"|\t|[^"\t]+')

# where in a field a reader is: at its start (or behind a delimiter taken out of it), in a plain part, in a quoted one, behind a quote of a quoted one
START, PLAIN, QUOTED, CLOSED = range(4)


@dataclass(frozen=True)
class Parsed:
    """``reason`` is None for a valid record, which has its ``fields``."""

    fields: tuple[str, ...] | None
    reason: str | None


def is_record(line: str | None) -> bool:
    """Null, blank and comment lines are no records."""
    return bool(line) and not line.isspace() and line[0] != "#"


def zero_cost_fields(line: str) -> list[str] | None:
    """The fields if no quote is out of place, without their quotes; None otherwise."""
    if '"' not in line:
        return line.split("\t")
    out, at = [], 0
    while True:
        m = _FIELD.match(line, at)
        if m is None:
            return None
        out.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        if not m[3]:
            return out
        at = m.end()


def _step(state: int, symbol: str) -> int | None:
    """The state after an ordinary symbol, None where the format doesn't allow it."""
    if symbol == '"':
        return (QUOTED, None, CLOSED, QUOTED)[state]
    if symbol == "\t":
        return QUOTED if state == QUOTED else START
    return (PLAIN, PLAIN, QUOTED, None)[state]


def _quotes_to_go(symbols: list[str]) -> list[tuple[int, ...]]:
    """For each place and state the least number of quotes to insert or delete until the end, for any number of fields."""
    ahead = (0, 0, 1, 0)
    out = [ahead]
    for symbol in reversed(symbols):
        here = []
        for state in range(4):
            after, quoted = _step(state, symbol), _step(state, '"')
            cost = [ahead[after]] if after is not None else []
            if symbol == '"':
                cost.append(ahead[state] + 1)
            if quoted is not None and (twice := _step(quoted, symbol)) is not None:
                cost.append(ahead[twice] + 1)
            here.append(min(cost))
        ahead = tuple(here)
        out.append(ahead)
    return out[::-1]


#: What the field so far would be as an id, besides the number itself.
_NOTHING, _NO_ID = -1, -2


def _typed(value: int, text: str) -> int:
    """The id so far with ``text`` behind it."""
    if value == _NO_ID or _DIGITS.fullmatch(text) is None:
        return _NO_ID
    digits = text.lstrip("0") if value <= 0 else text
    if len(digits) > 10:
        return _NO_ID
    number = (max(value, 0) * 10 ** len(digits)) + int(digits or "0")
    return number if number <= MAX_ID else _NO_ID


#: The costs of a parse as one number, so that no number of cheaper edits outweighs a dearer one: quotes, delimiters, then begin and end typed anew.
_BEGIN, _END, _DELIMITER, _QUOTE = 2, 1, 4, 1 << 40
_REASONS = ((_QUOTE, "quoting"), (_DELIMITER, "columns"), (_BEGIN, "begin"), (_END, "end"))


@dataclass(frozen=True)
class Parse:
    """The cheapest parse of a line: its cost and the reason that it states (None at cost 0); with edits also these and the fields with their quotes."""

    cost: int
    reason: str | None
    edits: tuple[str, ...] = ()
    text: str | None = None


def cheapest_parse(line: str, with_edits: bool = False) -> Parse:
    """The parse of ``line`` as four fields, two of them ids, that takes the fewest edits of quotes, then of delimiters, then of ids.

    A quote may be inserted or deleted anywhere. A delimiter may be deleted, which
    joins two fields, or inserted where a field begins or ends, which adds an
    empty one; neither changes which quotes are in place, so a line whose quotes
    are in order never needs an edit of quotes, and one whose are not always does.
    The reason is the dearest kind of edit needed. Of equally cheap parses the one
    with the earliest steps in the order kept, deleted, inserted is taken.

    A state is what a reader knows: where in a field it is, which field, and what
    the field would be as an id. Only states on a way with the fewest edits of
    quotes are followed, known from a pass from the end. Time grows with the
    length of the line; without edits memory holds one state of each kind.
    """
    symbols = _SYMBOL.findall(line)
    quotes = _quotes_to_go(symbols)
    least = quotes[0][START]
    start = (START, 1, _NOTHING)
    here: dict[tuple[int, int, int], int] = {start: 0}
    steps: list[dict] = []

    def closed(key: tuple[int, int, int], cost: int) -> int:
        """The cost when the field of ``key`` ends."""
        return cost + ((_BEGIN if key[1] == 1 else _END) if key[1] <= 2 and key[2] < 0 else 0)

    for i, symbol in enumerate([*symbols, ""]):
        own: dict = {}
        ahead: dict[tuple[int, int, int], int] = {}
        to_go, then = quotes[i], quotes[min(i + 1, len(symbols))]

        def offer(layer: dict, place: int, key: tuple[int, int, int], cost: int, back: tuple, go: int) -> None:
            if key[1] <= FIELDS and (cost >> 40) + go == least and cost < layer.get(key, 1 << 80):  # noqa: B023
                layer[key] = cost
                if with_edits:
                    own[place, key] = back  # noqa: B023

        # delimiters inserted where a field begins or, before a delimiter or the end of the line, ends
        todo = list(here)
        while todo:
            key = todo.pop()
            state, n, _ = key
            if state == START or (state != QUOTED and symbol in ("", "\t")):
                new = (START, n + 1, _NOTHING if n < 2 else 0)
                before = here.get(new, 1 << 80)
                offer(here, 0, new, closed(key, here[key]) + _DELIMITER, (key, "insert delimiter"), to_go[START])
                if here.get(new, 1 << 80) < before:
                    todo.append(new)
        for key, cost in here.items():
            state, n, value = key
            for edit, at, price in (("", state, 0), ("insert quote", _step(state, '"'), _QUOTE)):
                if not symbol:  # an open field is closed, any other stays as it is
                    if bool(edit) == (state == QUOTED):
                        offer(ahead, 1, (CLOSED, n, value) if edit else key, cost + price, (key, edit), 0)
                    continue
                if at is None:
                    continue
                after = _step(at, symbol)
                if after is None:
                    continue
                # an inserted quote behind a closing one is data, and so is the symbol in quotes
                held = _NO_ID if edit and state == CLOSED and n <= 2 else value
                if symbol == "\t" and at != QUOTED:
                    offer(ahead, 1, (START, n + 1, _NOTHING if n < 2 else 0), closed((at, n, held), cost) + price, (key, edit), then[START])
                    continue
                if n <= 2 and (symbol != '"' or at == CLOSED):
                    held = _typed(held, symbol)
                offer(ahead, 1, (after, n, held), cost + price, (key, edit), then[after])
            if symbol == '"':
                offer(ahead, 1, key, cost + _QUOTE, (key, "delete quote"), then[state])
            elif symbol == "\t" and state != QUOTED:
                offer(ahead, 1, (START, n, value), cost + _DELIMITER, (key, "delete delimiter"), then[START])
        steps.append(own)
        here = ahead
    cost, key = min((closed(k, c), k) for k, c in here.items() if k[1] == FIELDS)
    reason = next((r for price, r in _REASONS if cost >= price), None)
    if not with_edits:
        return Parse(cost, reason)
    return Parse(cost, reason, *_traced(line, symbols, steps, key))


def _traced(line: str, symbols: list[str], steps: list[dict], key: tuple[int, int, int]) -> tuple[tuple[str, ...], str]:
    """The edits of the parse that ends in ``key``, and the fields it gives, quoted where quotes hold any part of them."""
    way: list[tuple[int, str, tuple[int, int, int]]] = []  # place, edit, state before
    for i in range(len(symbols), -1, -1):
        if (1, key) in steps[i]:
            before, edit = steps[i][1, key]
            way.append((i, edit or "keep", before))
            key = before
        while (0, key) in steps[i]:
            before, edit = steps[i][0, key]
            way.append((i, edit, before))
            key = before
    starts = [0]
    for symbol in symbols:
        starts.append(starts[-1] + len(symbol))
    edits, fields, held, quoted = [], [], [], False

    def ended() -> None:
        nonlocal held, quoted
        text = "".join(held)
        if len(fields) < 2 and _id(text) is None:
            edits.append(f"retype {('begin', 'end')[len(fields)]}")
        fields.append('"' + text.replace('"', '""') + '"' if quoted else text)
        held, quoted = [], False

    for i, edit, (state, _, _) in reversed(way):
        if edit != "keep":
            edits.append(f"{edit} at {starts[i]}")
        if edit == "insert delimiter":
            ended()
            continue
        if edit.startswith("delete"):
            continue
        for symbol in (['"'] if edit == "insert quote" else []) + ([symbols[i]] if i < len(symbols) else []):
            after = _step(state, symbol)
            if symbol == "\t" and state != QUOTED:
                ended()
            elif symbol != '"' or state == CLOSED:
                held.append(symbol)
            quoted = quoted or after == QUOTED
            state = after
    ended()
    return tuple(edits), "\t".join(fields)


def _id(text: str) -> int | None:
    """The number, None if it is no valid id; of leading zeros there may be thousands."""
    if _DIGITS.fullmatch(text) is None:
        return None
    digits = text.lstrip("0") or "0"
    return int(digits) if len(digits) <= 10 and int(digits) <= MAX_ID else None


def parse_line(line: str) -> Parsed:
    """A record's fields, or the first reason that holds of quoting, columns, begin and end, as the cheapest parse states it."""
    fields = zero_cost_fields(line)
    if fields is not None and len(fields) == FIELDS and _id(fields[0]) is not None and _id(fields[1]) is not None:
        return Parsed(tuple(fields), None)
    return Parsed(None, cheapest_parse(line).reason)


def _parser(with_edits: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [], [])
            for line_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not is_record(line):
                    continue
                p = parse_line(line)
                begin, end, tag, remark = p.fields or (None,) * 4
                edits, repaired = None, None
                if with_edits and p.reason:
                    best = cheapest_parse(line, with_edits=True)
                    edits, repaired = best.edits, best.text
                for column, value in zip(out, (line_id, begin and _id(begin), end and _id(end), tag, remark, p.reason, edits, repaired), strict=True):
                    column.append(value)
            kinds = (batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            names = ("line_id", "begin", "end", "tag", "remark", "reason", "edits", "repaired")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def parse_lines(raw: DataFrame, with_edits: bool = False) -> DataFrame:
    """``(line_id, begin, end, tag, remark, reason, edits, repaired)``: one row for each record among the lines.

    Valid records have typed fields and no ``reason``; broken ones have a reason
    and no fields, and with ``with_edits`` the edits of the cheapest parse and the
    line so repaired: four fields with every quote in place (ids to be typed anew
    are named but stay as they are). Null, blank and comment lines give no row. Repeated lines
    and repeated or null line_ids are kept, a row each. No shuffle.
    """
    schema = "line_id bigint, begin bigint, end bigint, tag string, remark string, reason string, edits array<string>, repaired string"
    lines = raw.select(F.col("line_id").cast("bigint").alias("line_id"), F.col("line").cast("string").alias("line"))
    return lines.where(F.col("line").isNotNull()).mapInArrow(_parser(with_edits), schema)


def loaded_lines(raw: DataFrame) -> DataFrame:
    """``(line_id, begin, end, tag, remark)`` of the valid records."""
    return parse_lines(raw).where(F.col("reason").isNull()).select("line_id", "begin", "end", "tag", "remark")


def broken_lines(raw: DataFrame) -> DataFrame:
    """``(line_id, reason)`` of the broken records."""
    return parse_lines(raw).where(F.col("reason").isNotNull()).select("line_id", "reason")


def repairs(raw: DataFrame) -> DataFrame:
    """``(line_id, reason, edits, repaired)`` of the broken records."""
    return parse_lines(raw, with_edits=True).where(F.col("reason").isNotNull()).select("line_id", "reason", "edits", "repaired")


#: A line of four fields with every quote in place.
IN_PLACE = r'(?s)^(?:"(?:[^"]|"")*"|[^"\t]*)(?:\t(?:"(?:[^"]|"")*"|[^"\t]*)){3}\z'


def repair_report(raw: DataFrame) -> DataFrame:
    """``(line_id, reason, in_place, delimiters)`` of the broken records: whether the repaired line has four fields with every quote in place, and the number of delimiters edited, null where quotes are at fault."""
    number = lambda word: F.when(F.col("reason") != "quoting", F.size(F.filter("edits", lambda e: e.contains(word))))
    return repairs(raw).select("line_id", "reason", F.col("repaired").rlike(IN_PLACE).alias("in_place"), number("delimiter").cast("bigint").alias("delimiters"))
