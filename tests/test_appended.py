"""Append-only tables: all rows, few files, whatever happens between."""

import pytest

from oreworks.sinks import appended, tables
from oreworks.sinks.published import published


def add(spark, path, *numbers, fan=4):
    appended.append(spark.createDataFrame([(n, f"run {n}") for n in numbers], "n int, run string").coalesce(1), path, fan)


def numbers(spark, path):
    return sorted(r["n"] for r in tables.read(spark, path).collect())


def test_many_appends_few_files(spark, tmp_path):
    path = str(tmp_path / "history")
    for n in range(18):
        add(spark, path, n)
    assert numbers(spark, path) == list(range(18))
    assert len(published(spark, path)[""]) < 4
    assert len(tables.read(spark, path).inputFiles()) < 8
    # Folders of the pointer before last are gone.
    assert len(list((tmp_path / "history" / "_versions").iterdir())) < 10


def test_a_thousand_appends_by_sizes():
    """Folder counts and rewritten bytes, by the rule alone."""
    sizes, rewritten, most = {}, 0, 0
    for n in range(1000):
        sizes[f"r{n}"] = 3000
        while group := appended.due(sizes):
            size = max(3000, 60 * len(group) + sum(sizes[g] for g in group) // 4)
            for g in group:
                del sizes[g]
            sizes[f"m{n}-{size}"] = size
            rewritten += size
        most = max(most, len(sizes))
    assert most < 3 * appended.FAN
    assert rewritten < 3 * 1000 * 3000


def test_large_folders_are_left_alone():
    sizes = {f"r{n}": appended.LARGEST + n for n in range(100)}
    assert appended.due(sizes) == []
    assert appended.due({**sizes, **{f"s{n}": 10 for n in range(appended.FAN)}}) == [f"s{n}" for n in range(appended.FAN)]


def test_rows_of_a_plain_folder_stay(spark, tmp_path):
    path = str(tmp_path / "plain")
    for n in (1, 2):
        spark.createDataFrame([(n, "old")], "n int, run string").write.mode("append").parquet(path)
    add(spark, path, 3)
    add(spark, path, 4)
    assert numbers(spark, path) == [1, 2, 3, 4]


def test_an_append_that_fails_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "failing")
    add(spark, path, 1)
    bad = spark.range(3).selectExpr("CAST(id AS int) AS n", "IF(id = 2, raise_error('lost'), 'x') AS run")
    with pytest.raises(Exception, match="lost"):
        appended.append(bad, path)
    assert numbers(spark, path) == [1]
    assert len(list((tmp_path / "failing" / "_versions").iterdir())) == 1


def test_what_is_appended_during_a_merge_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "busy")
    for n in range(3):
        add(spark, path, n)
    size, done = appended._size, []

    def meanwhile(*args):
        if not done:
            done.append(True)
            add(spark, path, 99, fan=1000)
        return size(*args)

    monkeypatch.setattr(appended, "_size", meanwhile)
    add(spark, path, 3)
    assert numbers(spark, path) == [0, 1, 2, 3, 99]
    assert len(published(spark, path)[""]) == 2


def test_of_two_merges_at_once_one_counts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "twice")
    for n in range(4):
        add(spark, path, n, fan=1000)
    instead, done = appended._instead, []

    def other_first(now, group, merged):
        if not done:
            done.append(True)
            appended.merge(spark, path, 4)
            now = published(spark, path)
        return instead(now, group, merged)

    monkeypatch.setattr(appended, "_instead", other_first)
    appended.merge(spark, path, 4)
    assert numbers(spark, path) == [0, 1, 2, 3]
    assert len(published(spark, path)[""]) == 1


def test_empty_rows_and_columns_that_come_later(spark, tmp_path):
    path = str(tmp_path / "columns")
    appended.append(spark.createDataFrame([], "n int, run string"), path, 3)
    add(spark, path, 1, fan=3)
    appended.append(spark.createDataFrame([(2, "x", "more")], "n int, run string, v2 string").coalesce(1), path, 3)
    stored = tables.read(spark, path)
    assert stored.columns == ["n", "run", "v2"]
    assert sorted((r["n"], r["v2"]) for r in stored.collect()) == [(1, None), (2, "more")]
