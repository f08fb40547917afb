from __future__ import annotations

import pytest

from palaver.operators import export


def test_backup_keeps_one_version_below_the_root(spark, tmp_path):
    own = tmp_path / "p" / "a" / "só.jsonl"
    own.parent.mkdir(parents=True)
    own.write_text("x\n")
    for _ in range(2):
        kept = export.backup(spark, str(tmp_path / "p"), str(tmp_path / "b"), str(own))
    assert open(kept).read() == "x\n" and len(list((tmp_path / "b").rglob("*.jsonl"))) == 1 and "/a_só_jsonl/" in kept
    rows = export.list_backups(spark, str(tmp_path / "p"), str(tmp_path / "b"), str(own)).collect()
    assert [(r["version"], r["size"], r["path"]) for r in rows] == [(1, 2, kept)]
    for other in (tmp_path / "other", tmp_path / "p" / ".." / "x"):
        with pytest.raises(ValueError):
            export.backup(spark, str(tmp_path / "p"), str(tmp_path / "b"), str(other))


def test_pages(spark):
    assert "<i>" not in export.page("a<i>", [("user", "<i>x")]) and export.file_name("~/My App", "A: b!") == "my_app_a_b.html" and export.file_name("", "") == "project_session.html"
    rows = spark.createDataFrame([("~/My App", "A: <b>!", [("user", "<i>x"), ("assistant", "y & z")]), ("", None, [])], "project string, title string, turns array<struct<role: string, text: string>>")
    bad = spark.createDataFrame([("", "t", [('"><i>', "x")])], "project string, title string, turns array<struct<role: string, text: string>>")
    held = export.export_pages(bad).first()["html"]
    assert "<i>" not in held and 'class="turn &quot;&gt;&lt;i&gt;">' in held and held == export.page("t", [('"><i>', "x")])
    pages = {r["file_name"]: r["html"] for r in export.export_pages(rows).collect()}
    assert set(pages) == {"my_app_a_b.html", "project_session.html"} and "&lt;i&gt;x" in pages["my_app_a_b.html"] and "<title>A: &lt;b&gt;!" in pages["my_app_a_b.html"]
