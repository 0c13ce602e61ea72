"""CSV files in splits against a reader that takes them whole."""

import csv
import io
import random

import pytest

from fieldweave.sources import csv_records as R
from fieldweave.sources.files import scan_csv_config


@pytest.fixture
def tiny_splits(spark):
    """Files are cut every few bytes, so records and headers lie across splits."""
    names = {"spark.sql.files.maxPartitionBytes": "48", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def expected(text, header_row, delimiter=","):
    rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter))
    head = rows[header_row]
    for row in rows[header_row + 1 :]:
        if "".join(row).strip():
            yield tuple(sorted((h, row[i] or None if i < len(row) else None) for i, h in enumerate(head)))


def got(df):
    return sorted((tuple(sorted(r.asDict().items())) for r in df.collect()), key=repr)


@pytest.mark.parametrize("header_row", [0, 2])
def test_line_breaks_in_quotes(spark, tmp_path, header_row):
    """One field, also with Windows line ends, and also in the lines above the header."""
    top = ["", "title\n\"made\nby\"\n"][header_row > 0]
    (tmp_path / "a.csv").write_bytes((top + 'k,v\n1,"a\nb"\n2,"x ""q""\n\n,y"\n3,7" pipe\n4,"w"\r\n').encode())
    want = [("1", "a\nb"), ("2", 'x "q"\n\n,y'), ("3", '7" pipe'), ("4", "w")]
    assert sorted(tuple(r) for r in scan_csv_config(spark, str(tmp_path), None, ",", "utf-8", header_row).collect()) == want
    assert sorted(tuple(r) for r in scan_csv_config(spark, str(tmp_path), ["k", "v"], ",", "utf-8", header_row).collect()) == want


@pytest.mark.parametrize("header_row", [0, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_equal_whole_files(spark, tmp_path, tiny_splits, header_row, seed):
    rng = random.Random(seed)
    pieces = ["a", "long word", 'say "x"', "two\nlines", "\n", ",", "é", "7", '"', "l1\nl2\n\nl4"]
    want = []
    for f in range(4):
        names = rng.sample(["p", "q", "r", "s"], 3)
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        for i in range(header_row):
            w.writerow(["above", rng.choice(pieces)])
        w.writerow(names)
        for i in range(rng.randrange(1, 60)):
            w.writerow([f"{f}-{i}", rng.choice(pieces), rng.choice(pieces)])
        (tmp_path / f"{f}.csv").write_bytes(out.getvalue().encode())
        for row in expected(out.getvalue(), header_row):
            want.append({n: None for n in "pqrs"} | dict(row))
    df = scan_csv_config(spark, str(tmp_path), None, ",", "utf-8", header_row)
    names = {n for w in want for n in w}
    assert sorted(df.columns) == sorted(names)
    assert got(df) == sorted((tuple(sorted(w.items())) for w in want), key=repr)


def test_many_layouts(spark, tmp_path):
    for i in range(500):
        (tmp_path / f"{i}.csv").write_text(f"k,only{i % 250}{'x' * (i // 250)}\n{i},v{i}\n")
    df = scan_csv_config(spark, str(tmp_path), None, ",")
    rows = df.collect()
    assert len(df.columns) == 501 and len(rows) == 500
    assert all([v for c, v in r.asDict().items() if c != "k" and v] == [f"v{r['k']}"] for r in rows)


def test_a_quote_that_never_closes(spark, tmp_path, tiny_splits):
    """It does not swallow the rest of the file: from there on every line is a record."""
    rest = "".join(f"{i},z{i}\n" for i in range(40))
    (tmp_path / "a.csv").write_text('k,v\n1,"a\nb"\n2,"open\n' + rest)
    lines = R.file_lines(spark, str(tmp_path))
    headers, body = R.records(lines, R.line_blocks(lines, ","), ",", 0)
    assert [r["header"] for r in headers.collect()] == ["k,v"]
    assert sorted(r["record"] for r in body.collect()) == sorted(['1,"a\nb"', '2,"open', *rest.split()])


def test_names_missing_or_twice(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t\na,,a,B\n1,2,3,"4\n"\n')
    (tmp_path / "b.csv").write_text("t\nb\n5\n")
    df = scan_csv_config(spark, str(tmp_path), None, ",", "utf-8", 1)
    assert df.columns == ["a0", "_c1", "a2", "B"]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([("1", "2", "3", "4\n"), (None, None, None, "5")], key=repr)


def test_wide_characters_and_short_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('k;v\n1;"é\nß"\n'.encode("utf-16"))
    assert [tuple(r) for r in scan_csv_config(spark, str(tmp_path), None, ";", "utf-16").collect()] == [("1", "é\nß")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text("only\n")
    with pytest.raises(ValueError, match="no header line"):
        scan_csv_config(spark, str(tmp_path / "b"), None, ";", "utf-8", 3)
