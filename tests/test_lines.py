import random
from collections import Counter
from itertools import product

import pytest

from graphloom.sources import lines

CASES = [
    ("1\t2\ta\tb", None), ("1\t2\t\t", None), ('"1"\t"2"\t""\t"x\ty\nz""q"', None), ("0001\t4294967295\t\t", None), ("1\t2\t\\\tb", None), ("1\t2\ta\nb\tc", None),
    ("1\t4294967296\t\t", "end"), ("x\ty\t\t", "begin"), ("\t2\t\t", "begin"), ("1\t\t\t", "end"), ("1 \t2\t\t", "begin"), ("-1\t2\t\t", "begin"), ("١\t2\t\t", "begin"), ('"1\t2\t3\t4"', "columns"), ("1" * 50 + "\t2\t\t", "begin"), ("0" * 5000 + "7\t2\t\t", None),
    ("1\t2\t3", "columns"), ("1\t2\t3\t4\t5", "columns"), ("1", "columns"), ("1 2 3 4", "columns"), ("x\t2\t3", "columns"),
    ('1\t2\t"a\tb', "quoting"), ('1\t2\ta"b\tc', "quoting"), ('"1"x\t2\t\t', "quoting"), ('1\t2\t"a""\t', "quoting"), ('1\t2\t\t"', "quoting"), ('1\t2\t "a"\tb', "quoting"), ('"x', "quoting"), ('1"', "quoting"),
]


@pytest.mark.parametrize(("line", "reason"), CASES)
def test_reasons(line, reason):
    assert lines.parse_line(line).reason == reason


@pytest.mark.parametrize("line", [None, "", " ", "\t\t\t", "　\t", "# 1\t2\t3\t4", "#"])
def test_no_records(line):
    assert not lines.is_record(line)


def test_fields_without_their_quotes():
    assert lines.parse_line('"07"\t2\t"a\t""b"""\t"x\ny"').fields == ("07", "2", 'a\t"b"', "x\ny")


def by_definition(line):
    fields = lines.zero_cost_fields(line)
    if fields is None:
        return "quoting"
    if len(fields) != lines.FIELDS:
        return "columns"
    return next((name for name, text in zip(("begin", "end"), fields, strict=False) if lines._id(text) is None), None)


@pytest.mark.parametrize("first", list('"\t1x'))
def test_the_edits_of_every_short_line_state_its_reason(first):
    for n in range(6):
        for rest in product('"\t1x', repeat=n):
            line = "".join((first, *rest))
            plain, best = lines.cheapest_parse(line), lines.cheapest_parse(line, with_edits=True)
            assert plain.reason == best.reason == by_definition(line), line
            assert plain.cost == best.cost
            # the reason is the dearest kind among the edits, and the line so repaired is in order
            kinds = Counter(" ".join(e.split()[:2]) for e in best.edits)
            dearest = "quoting" if any("quote" in k for k in kinds) else "columns" if any("delimiter" in k for k in kinds) else "begin" if kinds["retype begin"] else "end" if kinds["retype end"] else None
            assert dearest == best.reason, (line, best)
            fields = lines.zero_cost_fields(best.text)
            assert fields is not None and len(fields) == lines.FIELDS, (line, best)
            assert [lines._id(f) is None for f in fields[:2]] == [kinds["retype begin"] > 0, kinds["retype end"] > 0], (line, best)


def quotes_away(line, most=3):
    """Least number of quotes to insert or delete until all are in place, by trying all."""
    seen, front = {line}, [line]
    for cost in range(most + 1):
        if any(lines.zero_cost_fields(s) is not None for s in front):
            return cost
        ahead = set()
        for s in front:
            ahead |= {s[:i] + s[i + 1 :] for i in range(len(s)) if s[i] == '"'}
            ahead |= {s[:i] + '"' + s[i:] for i in range(len(s) + 1)}
        front = [s for s in ahead if s not in seen]
        seen |= ahead
    return most + 1


def test_parse_is_cheapest():
    rng = random.Random(5)
    for _ in range(300):
        line = "".join(rng.choice('1x"\t') for _ in range(rng.randrange(1, 10)))
        best = lines.cheapest_parse(line, with_edits=True)
        number = sum("quote" in e for e in best.edits)
        least = quotes_away(line)
        assert number == least or (least == 4 and number >= 4), (line, best)
        if not number:
            assert sum("delimiter" in e for e in best.edits) == abs(len(lines.zero_cost_fields(line)) - lines.FIELDS)


def test_edits_leave_good_ids_where_they_can():
    assert lines.cheapest_parse("1\t2", with_edits=True).text == "1\t2\t\t"
    best = lines.cheapest_parse("1\t7\tx\ta\tb", with_edits=True)
    assert best.text.startswith("1\t7\t") and best.cost == lines._DELIMITER
    assert lines.cheapest_parse("4294967295\t9\t2\t\t", with_edits=True).text.startswith("4294967295\t9")
    assert lines.cheapest_parse('1\t2\t"a\tb', with_edits=True).text == '1\t2\t"a"\tb'
    assert lines.cheapest_parse('"a"\tb\t"c"\td\t"e"').reason == "columns"  # joined fields are quoted anew


def test_table(spark):
    rows = [(i, line, i, "x") for i, (line, _) in enumerate(CASES)] + [(900, None, 0, ""), (901, "#", 0, ""), (0, CASES[0][0], 0, ""), (None, "1", 0, "")]
    raw = spark.createDataFrame(rows, "line_id long, line string, begin int, reason string")
    got = sorted(map(tuple, lines.broken_lines(raw).collect()), key=repr)
    assert got == sorted([(i, r) for i, (_, r) in enumerate(CASES) if r] + [(None, "columns")], key=repr)
    loaded = {r.line_id: (r.begin, r.end, r.tag, r.remark) for r in lines.loaded_lines(raw).collect()}
    assert loaded[0] == (1, 2, "a", "b") and loaded[3] == (1, 4294967295, "", "")
    assert lines.loaded_lines(raw).count() == 1 + sum(r is None for _, r in CASES)
    assert lines.repairs(raw).where("repaired is null or size(edits) = 0").count() == 0
    assert lines.broken_lines(raw.where("false")).count() == 0


def test_long_lines():
    assert lines.parse_line('1\t2\t"' + 'a""' * 200_000 + '"\tz').reason is None
    assert lines.parse_line('1\t2\t"' + 'a""' * 50_000).reason == "quoting"
    assert len(lines.cheapest_parse('1\t2\t"' + 'a""' * 20_000, with_edits=True).text) > 60_000
    assert lines.parse_line("1\t" * 20_000).reason == "columns"
