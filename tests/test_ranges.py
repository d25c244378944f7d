"""Files with records that span lines, cut into byte ranges."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest

from burnish.sources.ranges import MARK, DelimitedLines, JsonObjects, cutting, pieces, scan, summarise
from burnish.sources.ranges import SUMMARY, compose
from burnish.sources.readers import read_csv, read_json_array

STARTS = (("quoted", pa.bool_()), ("depth", pa.int64()), ("last", pa.bool_()), ("unended", pa.bool_()))


def cut_by_hand(kind, text, block, batch):
    """All records of a file in ranges of ``block`` bytes, whose pieces come ``batch`` at a time."""
    mark = kind.separator.encode()
    parts = text.split(mark)
    if not parts[-1]:
        parts.pop()
    rows, at = [], 0
    for part in parts:  # a piece that starts right at a border still belongs to the range before
        rows.append((max(0, at - 1) // block * block, part))
        at += len(part) + 1

    def batches(starts=None):
        for low in range(0, len(rows), batch):
            some = rows[low : low + batch]
            columns = {
                "file": pa.array([1] * len(some), pa.int64()),
                "block": pa.array([b for b, _ in some], pa.int64()),
                "size": pa.array([len(text)] * len(some), pa.int64()),
                "value": pa.array([x for _, x in some], pa.binary()),
            }
            for name, arrow in STARTS if starts else ():
                columns[name] = pa.array([starts[b][name] for b, _ in some], arrow)
            yield pa.RecordBatch.from_pydict(columns)

    starts = {r["block"]: r for r in compose(pa.Table.from_batches(list(summarise(kind)(batches())), SUMMARY)).to_pylist()}
    whole, parts = ([r for b in cutting(kind, f)(batches(starts)) for r in b.to_pylist()] for f in (False, True))
    joined = {}
    for r in sorted(parts, key=lambda r: (r["block"], r["part"])):
        if r["opens"]:
            joined[len(joined)] = r["value"]
        else:
            joined[len(joined) - 1] += r["value"]
    assert sum(r["first"] for r in whole + parts) <= 1
    return [r["value"] for r in whole] + [kind.value(v) for v in joined.values() if v.strip()]


def value(draw, depth=0):
    kind = draw.random()
    if kind < 0.4 or depth > 3:
        return "".join(draw.choice('ab"\\{}[],:é \n') for _ in range(draw.randint(0, 9)))
    if kind < 0.6:
        return draw.choice([None, 7, -1.5, True])
    if kind < 0.8:
        return {draw.choice(["x", "y{", 'z"']): value(draw, depth + 1) for _ in range(draw.randint(0, 3))}
    return [value(draw, depth + 1) for _ in range(draw.randint(0, 3))]


@pytest.mark.parametrize("block", [3, 11, 50, 10**6])
def test_objects_in_any_ranges(block):
    draw = random.Random(block)
    for _ in range(200):
        records = [{f"k{i}": value(draw) for i in range(draw.randint(0, 3))} for _ in range(draw.randint(0, 9))]
        text = json.dumps(records, indent=draw.choice([None, 1]), ensure_ascii=draw.random() < 0.5).encode()
        text = draw.choice([b"", MARK]) + text + draw.choice([b"", b"\n"])
        got = cut_by_hand(JsonObjects(), text, block, draw.choice([1, 2, 100]))
        assert sorted(json.dumps(json.loads(v)) for v in got) == sorted(map(json.dumps, records))


def test_what_is_no_object_is_not_lost():
    got = cut_by_hand(JsonObjects(), b'[{"a": 1}, null, {"b": 2}, 7, {"c": [', 5, 2)
    assert sorted(got) == sorted([b'{"a": 1}', b"null", b'{"b": 2}', b"7", b'{"c":'])
    with pytest.raises(ValueError, match="closing brace"):
        cut_by_hand(JsonObjects(), b'{"a": 1}} {}', 99, 9)


@pytest.mark.parametrize("block", [2, 7, 30, 10**6])
def test_lines_in_any_ranges(block):
    draw = random.Random(block)
    for _ in range(300):
        sep, end = draw.choice([",", "\t", ";;"]), draw.choice(["\n", "\r\n"])
        lines = []
        for _ in range(draw.randint(1, 8)):
            cells = ["".join(draw.choice('ab"\n\r,;\té ') for _ in range(draw.randint(0, 6))) for _ in range(draw.randint(1, 4))]
            plain = lambda x: not (x.startswith('"') or set(x) & set("\n\r;") or sep in x)
            lines.append(sep.join(x if plain(x) else '"' + x.replace('"', '""') + '"' for x in cells))
        text = (end.join(lines) + draw.choice(["", end])).encode()
        got = cut_by_hand(DelimitedLines(sep), text, block, draw.choice([1, 2, 100])) if text else []
        assert sorted(v for v in got if v.strip()) == sorted(x.encode() for x in lines if x.strip())


@pytest.fixture
def small_ranges(spark):
    """Files are cut into ranges of 16 KB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def long_rows(count):
    draw = random.Random(5)
    return [(k, draw.random() < 0.5, "".join(draw.choice('xy"\n, é') for _ in range(draw.randint(0, 60)))) for k in range(count)]


def as_csv(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([("id", "b", "t,\nu"), *rows])
    return out.getvalue()


def test_one_file_with_line_breaks_in_cells_is_read_by_many_tasks(small_ranges, tmp_path):
    rows = long_rows(5_000)
    (tmp_path / "a b%201.csv").write_text(as_csv(rows))
    ranges = scan(small_ranges, str(tmp_path), DelimitedLines(","))
    assert ranges.starts.count() >= 8 and ranges.pieces.rdd.getNumPartitions() >= 8
    df = read_csv(small_ranges, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields] == [("id", "bigint"), ("b", "boolean"), ("t,\nu", "string")]
    from burnish.functions.columns import MISSING_TOKENS

    want = [(k, b, None if t in MISSING_TOKENS else t) for k, b, t in rows]
    assert [tuple(r) for r in df.orderBy("id").collect()] == want
    typed = read_csv(small_ranges, str(tmp_path), schema="id double, b string, `t,\nu` string")
    assert typed.count() == 5_000


def test_odd_quotes_slow_only_their_file(small_ranges, tmp_path, plan_of):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f"{k},{k}\n" for k in range(8_000)))
    (tmp_path / "b.csv").write_text('id,v\n9000,"p\nq"\n9001,5" wide\n9002,z\n')
    (tmp_path / "c.csv").write_text('id,v\n9003,"never closed\n9004,w\n')
    df = read_csv(small_ranges, str(tmp_path), schema="id long, v string")
    got = {r["id"]: r["v"] for r in df.where("id >= 9000").collect()}
    assert got == {9000: "p\nq", 9001: '5" wide', 9002: "z", 9003: "never closed\n9004,w\n"} and df.count() == 8_004
    assert df.rdd.getNumPartitions() >= 5
    assert read_csv(small_ranges, str(tmp_path), quoted_newlines=False).count() == 8_000 + 4 + 2


def test_one_list_is_read_by_many_tasks(small_ranges, tmp_path):
    draw = random.Random(6)
    rows = [{"id": k, "t": value(draw), "n": {"d": [1, {"e": "}"}]}} for k in range(4_000)]
    rows = [r | {"t": json.dumps(r["t"])} for r in rows]
    (tmp_path / "one.json").write_text(json.dumps(rows))
    ranges = scan(small_ranges, str(tmp_path), JsonObjects())
    assert ranges.starts.count() >= 8 and ranges.starts.where("depth > 0").count() >= 4
    for schema in (None, "id long, n struct<d: array<string>>, t string"):
        df = read_json_array(small_ranges, str(tmp_path), schema)
        assert [(r["id"], r["t"]) for r in df.orderBy("id").collect()] == [(r["id"], r["t"]) for r in rows]
        assert df.where("n.d[0] = '1'").count() == 4_000
        assert df.rdd.getNumPartitions() >= 8


def test_single_objects_and_unreadable_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "t": "x"}')
    (tmp_path / "b.json").write_text('[{"id": 2, "t": "y"}, {"id": 3, "t": "cut o')
    (tmp_path / "c.json").write_text("[]")
    got = read_json_array(spark, str(tmp_path), "id long, t string").collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, "x"), (2, "y"), (None, None)]
    assert read_json_array(spark, str(tmp_path)).where("id is not null").count() == 2
    assert pieces(spark, str(tmp_path / "c.json"), JsonObjects()).count() == 1


def test_records_are_cut_once(small_ranges, tmp_path):
    """One pass gives whole records and fragments; later passes read what it wrote, not the lines."""
    rows = [[str(k), "a\nb" * (k % 9), 'c",' * (k % 5), "\r\n"] for k in range(400)]
    with open(tmp_path / "part.csv", "w", newline="") as file:
        csv.writer(file).writerows(rows)
    records = scan(small_ranges, str(tmp_path), DelimitedLines(",")).records()
    plan = records._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
    assert sorted(next(csv.reader([r["value"]]))[0] for r in records.collect()) == sorted(r[0] for r in rows)


@pytest.mark.parametrize("sep", [",", "||"])
def test_quotes_in_a_row(sep):
    """Whether lines end in quotes, by their cells and without pairs of quotes."""
    draw, kind = random.Random(5), DelimitedLines(sep)
    for _ in range(3000):
        line = "".join(draw.choice(['"', '"', '""', sep, "a", "|"]) for _ in range(draw.randint(0, 12))).encode()
        for quoted in (False, True):
            assert kind._line(line, quoted) == kind._line_by_cells(line, quoted), (line, quoted)
