"""Export files read in ranges are what they are as a whole."""

import random

import pytest

from tracewell.sources.export_csv import PLAIN, QUOTED, ROW, ExportError, iter_rows, read_export, records, state_after
from tracewell.sources.specs import SPECS

SMALL = {"spark.sql.files.maxPartitionBytes": "150", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def text_of(rng, kind):
    spec = SPECS[kind]

    def cell():
        plain = "".join(rng.choices("ab é日'", k=rng.randint(0, 12)))
        return rng.choice([plain, f'"{plain}\n""{plain}"", {plain}"', f'"{plain}\r\n\n{plain}"', f'mid"{plain}', *([f'{plain}\\\n{plain}', f'"\\"{plain}\\\\"', f"\\,{plain}"] if spec.escape else []), '"' + "\n" * rng.choice([1, 300]) + '"'])

    names = list(spec.names)
    rng.shuffle(names)
    lines = ["x"] * spec.skip_rows + [",".join(names)]
    lines += [",".join(cell() for _ in names[: rng.choice([len(names), len(names), 2])]) if rng.random() > 0.1 else rng.choice(["", ",,", "N/A,"]) for _ in range(40)]
    return "".join(x + rng.choice(["\n", "\n", "\r\n", "\r"]) if k > spec.skip_rows else x + "\n" for k, x in enumerate(lines))


@pytest.mark.parametrize("seed, kind", [(0, "shares"), (1, "comments"), (2, "comments"), (3, "messages"), (4, "connections")])
def test_ranges_are_the_whole(spark, tmp_path, small_ranges, seed, kind):
    rng = random.Random(seed)
    text = text_of(rng, kind)
    (tmp_path / "x.csv").write_bytes(text.encode())
    got = read_export(spark, str(tmp_path / "x.csv"), kind)
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "x.csv")).rdd.getNumPartitions() > 5
    assert [tuple(r)[1:] for r in got.orderBy("row_idx").collect()] == [(k, *cells) for k, cells in enumerate(records(text, SPECS[kind]))]


def test_other_encodings_and_ends(spark, tmp_path, small_ranges):
    head = "Date,Link,Message\n"
    many = "".join(f"2026-01-05 10:00:00,l{k},caf\xe9 {k}\n" for k in range(60))
    (tmp_path / "latin.csv").write_bytes((head + many).encode("latin-1") + b"2026-01-05,\x93,x\n")
    rows = read_export(spark, str(tmp_path / "latin.csv"), "comments").orderBy("row_idx").collect()
    assert rows[59].Message == "café 59" and rows[60].Link == "“"
    (tmp_path / "wide.csv").write_bytes((head + many).encode("utf-16"))
    assert read_export(spark, str(tmp_path / "wide.csv"), "comments", encoding="UTF-16").count() == 60
    for end, fine in (("a,b,c\\\n", True), ("a,b,c\\", False), ("a,b,c\\\\", True), ('a,b,"c', False), ('a,b,"c\n', False), ('a,b,"c"', True)):
        (tmp_path / "end.csv").write_text(head + many + end)
        if fine:
            assert read_export(spark, str(tmp_path / "end.csv"), "comments").count() == 61
        else:
            with pytest.raises(ExportError, match="escape|quote"):
                read_export(spark, str(tmp_path / "end.csv"), "comments")


def test_several_files(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    texts = {f"{k}.csv": text_of(rng, "messages") for k in range(4)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    got = {(r.file.rsplit("/", 1)[1], r.row_idx): tuple(r)[2:] for r in read_export(spark, str(tmp_path), "messages").collect()}
    assert got == {(name, k): tuple(cells) for name, text in texts.items() for k, cells in enumerate(records(text, SPECS["messages"]))}


def test_kind_of_files_cut_anywhere(spark, tmp_path):
    """A mark at the start, and a character of two bytes at every place around 65,536."""
    head = "﻿Date,ShareLink,ShareCommentary,SharedUrl,MediaUrl,Visibility\n"
    for shift in (0, 1, 2):
        row = "2026-01-30 10:00:00,l," + "é" * 80 + ",,,\n"
        text = head + "2026-01-30 10:00:00,l," + "x" * shift + ",,,\n" + row * 400
        (tmp_path / "x.csv").write_bytes(text.encode())
        assert read_export(spark, str(tmp_path / "x.csv"), "auto").count() == 401


def test_states_follow_the_tokenizer():
    rng = random.Random(3)
    for _ in range(3000):
        escape = rng.choice([None, "\\"])
        line = "".join(rng.choices('",\\ax\r', k=rng.randint(0, 9)))
        for state, before in ((ROW, ""), (QUOTED, '"q\n'), (PLAIN, "p\\\n")):
            if state == PLAIN and not escape:
                continue
            rest = {ROW: "", QUOTED: '"', PLAIN: ""}[state_after(line, state, escape)]
            list(iter_rows(before + line + "\n" + rest, escape))  # closed where the state says so
            if rest:
                with pytest.raises(ExportError):
                    list(iter_rows(before + line + "\n", escape))
