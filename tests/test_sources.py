"""Session files: listing, extraction, index refresh, and record edits."""

from __future__ import annotations

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from palaver.functions import text as T
from palaver.operators import edit, index, search, sequence, stats
from palaver.sources import jsonl


def line(kind, content, **more):
    return json.dumps({"type": kind, "message": {"role": kind, "content": content}, **more}, ensure_ascii=False)


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "projects"
    own = root / "-srv-data-web"
    (own / "subagents").mkdir(parents=True)
    (root / "subagents").mkdir()
    rows = [
        line("queue-operation", "meta"),
        line("user", "<command-name>ls"),
        line("user", "kindly repair the widget", uuid="u1", timestamp="2026-07-02T10:00:00.000Z", cwd="/srv/data/web"),
        line("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "the wigdet is whole, the widgt too"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"b": 1, "a": "x"}}], uuid="a1", parentUuid="u1", isSidechain=True),
        line("user", [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "ok"}, {"type": "text", "text": "two"}]}], toolUseResult={"k": 1}),
        "not json {",
        "   ",
        line("user", "<system-reminder>hidden widget"),
        line("user", "<teammate-message id=1>hidden widget"),
        line("user", [{"type": "text", "text": "<local-command-caveat>x"}, {"type": "text", "text": "hidden widget"}]),
        line("user", "<task-notification><note>n</note></task-notification>"),
        line("skill-listing", "hidden widget"),
        line("user", "so [Request interrupted by user] widget", uuid="u9"),
        '{"type":"summary","type":"user","message":{"content":"said twice"}}',
        line("assistant", "a string is no block"),
    ]
    (own / "one.jsonl").write_text("\n".join(rows) + "\n")
    for name in ("agent-z9.jsonl", "readme.txt", "subagents/agent-a.jsonl", "subagents/agent-b.jsonl", "subagents/agent-b.meta.json"):
        (own / name).write_text(rows[2] + "\n")
    (root / "subagents" / "two.jsonl").write_text(rows[2])
    return root


def test_listing_and_extraction(spark, corpus):
    stubs = jsonl.list_sessions(spark, str(corpus))
    assert [r["session_path"].rsplit("/", 1)[1] for r in stubs.collect()] == ["one.jsonl"]
    assert "content" not in stubs._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert jsonl.count_subagents(spark, str(corpus), stubs).first()["subagents"] == 2
    lines = jsonl.read_lines(spark, str(corpus))
    found = sorted((r["line_no"], r["block_no"], r["source"], r["text"], r["ts_ms"]) for r in jsonl.search_blocks(lines).collect())
    assert found == [
        (2, 0, "user", "kindly repair the widget", 1782986400000), (3, 0, "assistant", "the wigdet is whole, the widgt too", None),
        (12, 0, "user", jsonl.INTERRUPTED, None), (13, 0, "user", "said twice", None),
    ]
    rows = {r["line_no"]: r for r in jsonl.entries(lines).collect()}
    assert (rows[3]["parent_uuid"], rows[3]["is_sidechain"], rows[4]["tool_use_result"], rows[2]["is_sidechain"]) == ("u1", True, '{"k":1}', False)
    kinds = [(r["line_no"], r["content_no"], r["kind"], r["text"], r["tool_id"]) for r in jsonl.content_blocks(jsonl.entries(lines)).filter("line_no < 5").orderBy("line_no", "content_no").collect()]
    assert kinds == [(3, 0, "thinking", "hm", None), (3, 1, "text", "the wigdet is whole, the widgt too", None), (3, 2, "tool_use", None, "t1"), (4, 0, "tool_result", "ok\ntwo", "t1")]
    seen = {r["line_no"]: r for r in jsonl.view_entries(lines).collect()}
    assert sorted(seen) == [2, 3, 4, 10, 12, 13, 14] and seen[10]["is_notice"] and not seen[10]["has_blocks"] and seen[12]["is_interruption"]
    assert [n for n, r in seen.items() if r["has_blocks"]] == [2, 3, 4, 12, 13] and not seen[4]["has_user_text"]
    assert [r["cwd"] for r in jsonl.first_cwd(lines).collect()] == [""]  # spaced keys are no raw match
    assert jsonl.project_labels(lines, "/home/x").first()[1:] == ("-srv-data-web", "data/web")[0:0] + ("-srv-data-web", "web")
    assert jsonl.read_session(spark, str(corpus / "-srv-data-web" / "one.jsonl")).startswith('{"type": "queue')


def test_roots(spark, tmp_path):
    """Absent, empty and unreadable places."""
    for root in (tmp_path / "absent", tmp_path):
        assert jsonl.list_sessions(spark, str(root)).count() == 0 and jsonl.read_lines(spark, str(root)).count() == 0
    assert jsonl.corpus_root(spark, str(tmp_path / "none"), str(tmp_path)) is None
    (tmp_path / "c" / "projects").mkdir(parents=True)
    assert jsonl.corpus_root(spark, str(tmp_path / "c"), str(tmp_path)) == f"{tmp_path}/c/projects"
    (tmp_path / ".claude" / "projects").mkdir(parents=True)
    assert jsonl.corpus_root(spark, str(tmp_path / "none"), str(tmp_path)) == f"{tmp_path}/.claude/projects"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "bad.jsonl").write_bytes(b"\xff\xfe")
    assert jsonl.read_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(UnicodeDecodeError):
        jsonl.read_session(spark, str(tmp_path / "p" / "bad.jsonl"))


def made(spark, texts):
    rows = [(f"/p/{name}.jsonl", "p", k, x) for name, text in texts.items() for k, x in enumerate(text)]
    return spark.createDataFrame(rows, jsonl.LINES)


def test_titles(spark):
    """An untimed line may set the title; the first timed one ends the search, an echo too."""
    at = {"timestamp": "2026-01-02T00:00:00Z"}
    cases = {
        "plain": ([line("user", "## first  one", **at), line("user", "second", **at)], "first one"),
        "echo": ([line("user", "<command-name>x", **at), line("user", "later", **at)], "Untitled"),
        "early": ([line("user", "early"), line("user", "<command-name>x", **at)], "early"),
        "untimed": ([line("user", "<command-name>x"), line("user", "next", **at)], "next"),
        "array": ([line("user", [{"type": "text", "text": "<command-name>y"}], **at)], "<command-name>y"),
        "image": ([line("user", [{"type": "image"}, {"type": "text", "text": "t"}], **at)], "Untitled"),
        "long": ([line("user", "x" * 90, **at)], "x" * 80 + "…"),
        "quotes": ([line("user", "“‘quoted’”", **at)], "quoted"),
        "none": ([line("assistant", [], model="m")], "Untitled"),
        "far": ([""] * 50 + [line("user", "too far", **at)], "Untitled"),
    }
    lines = made(spark, {k: v for k, (v, _) in cases.items()})
    got = {r["session_path"][3:-6]: r["title"] for r in stats.preview_meta(lines).collect()}
    assert got == {k: t for k, (_, t) in cases.items()}
    seen = {r["session_path"][3:-6]: r["title"] for r in stats.entry_meta(lines).collect()}
    assert seen["echo"] == "later" and seen["array"] == "Untitled" and seen["image"] == "t" and seen["far"] == "too far"
    renamed = made(spark, {"a": [line("user", "t", **at), '{"type":"custom-title","customTitle":"one"}', '{"type":"custom-title","customTitle":""}'], "b": ['{"type":"custom-title","customTitle":"two"}']})
    assert {r["session_path"]: r["custom_title"] for r in stats.custom_titles(renamed).collect()} == {"/p/a.jsonl": "", "/p/b.jsonl": "two"}
    assert {r["session_path"]: r["title"] for r in stats.shown_titles(renamed).collect()} == {"/p/a.jsonl": "t", "/p/b.jsonl": "two"}


def test_statistics(spark):
    """Escapes are decoded, nested keys are not seen, typed nulls spoil a line, models keep their order."""
    model = lambda m: json.dumps({"type": "assistant", "message": {"model": m, "content": []}})
    lines = made(spark, {
        "s": [model("b"), model("a"), model("b"), '{"type":"us\\u0065r","cwd":"/x\\/y","timestamp":"t1"}', '{"type":"note","text":"\\"type\\":\\"user\\""}', '{"type":"user","cwd":null}', "{bad", " ", "", '{"timestamp":"t0"}\r'],
        "empty": [""],
    })
    got = {r["session_path"]: r.asDict() for r in stats.scan(lines).collect()}
    own = got["/p/s.jsonl"]
    assert (own["line_count"], own["user_count"], own["assistant_count"], own["models"]) == (9, 1, 3, ["b", "a"])
    assert (own["cwd"], own["first_ts"], own["last_ts"]) == ("/x/y", "t1", "t0") and got["/p/empty.jsonl"]["line_count"] == 0
    info = {r["session_path"]: r for r in stats.info(lines).collect()}["/p/s.jsonl"]
    assert (info["line_count"], info["user_count"]) == (8, 2)
    files = spark.createDataFrame([("/p/s.jsonl", 5, 1), ("/p/empty.jsonl", 100, 1)], "session_path string, mtime long, size long")
    rich = stats.enrichment(lines, files, 1000).collect()
    assert [(r["session_path"], r["cleaned"]) for r in rich] == [("/p/empty.jsonl", True), ("/p/s.jsonl", False)]
    assert stats.enrichment_summary(stats.enrichment(lines, files, 999)).first()[:] == (2, 0)


def indexed(spark, corpus, tmp_path):
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    return index.open_index(spark, root)


def test_search_ranks_exact_before_typo(spark, corpus, tmp_path):
    own = indexed(spark, corpus, tmp_path)
    hits = search.search(own, "widget").collect()
    assert [h["line_no"] for h in hits] == [2, 3] and hits[0]["score"] > hits[1]["score"]
    assert [(r["start"], r["end"]) for r in hits[0]["match_ranges"]] == [(18, 24)]
    assert [(r["start"], r["end"]) for r in hits[1]["match_ranges"]] == [(25, 30)]  # the loss of a letter, not the swap
    assert search.search(own, "wdiget").count() == 1  # a swap is one edit, a swap and a loss are not
    assert search.search(own, "  ?! ").count() == 0 and search.summary(own, "zzzz").first()["scanned"] == 0
    plan = search.top(own, "widget")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "text#" not in plan
    none = index.open_index(spark, str(tmp_path / "nothing"))
    assert search.top(none, "widget").count() == 0 and none.files().count() == 0


def test_offsets_after_a_letter_that_grows(spark):
    rows = spark.createDataFrame([("Visiting İstanbul, then the end",)], "t string")
    text = "Visiting İstanbul, then the end"
    got = rows.select(T.match_ranges(F.col("t"), ["the"]).alias("r"), T.cold_ranges(F.col("t"), ["stanbul"]).alias("c"), T.cold_ranges(F.col("t"), ["istanbul"]).alias("n")).first()
    assert [text[r["start"] : r["end"]] for r in got["r"]] == ["the", "the"] and [text[r["start"] : r["end"]] for r in got["c"]] == ["stanbul"] and got["n"] == []


def test_refresh(spark, corpus, tmp_path):
    """New, unchanged, grown, another, deleted, unreadable; only what is stale is read."""
    root, folder = str(tmp_path / "index"), corpus / "-srv-data-web"
    assert index.refresh(spark, str(corpus), root) == {"new": 1}
    n = index.open_index(spark, root).blocks().count()
    assert n == 4 and index.status(spark, str(corpus), root) == {"indexed_sessions": 1, "total_sessions": 1, "blocks": 4, "building": False}
    assert index.refresh(spark, str(corpus), root) == {"unchanged": 1}
    path = folder / "one.jsonl"
    path.write_text(path.read_text() + line("user", "more") + "\n")
    (folder / "three.jsonl").write_text(line("user", "third gadget") + "\n")
    assert index.refresh(spark, str(corpus), root, [f"file:{folder}/three.jsonl"]) == {"new": 1}
    own = index.open_index(spark, root)
    last = spark.read.parquet(f"{root}/{list(own.segments)[-1]}/blocks")
    assert own.blocks().count() == 5 and [r["session_path"][-11:] for r in last.collect()] == ["three.jsonl"]
    assert index.refresh(spark, str(corpus), root) == {"changed": 1, "unchanged": 1}
    own = index.open_index(spark, root)
    assert own.blocks().count() == 6 and search.search(own, "gadget").count() == 1 and search.search(own, "widget").count() == 2
    assert own.totals() == tuple(own.files().selectExpr("sum(n_blocks)", "sum(n_tokens)").first())
    (folder / "three.jsonl").write_bytes(b"\xff broken")
    assert index.refresh(spark, str(corpus), root) == {"changed": 1, "unchanged": 1}
    assert search.search(index.open_index(spark, root), "gadget").count() == 1  # the old text stays
    path.unlink()
    counts = index.refresh(spark, str(corpus), root)
    assert counts.pop("deleted") == 1 and index.open_index(spark, root).blocks().count() == 1
    names = {p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith(".")}
    meta = index.open_index(spark, root).meta
    manifests = {n for n in names if n.startswith("_meta-")}
    assert len(manifests) == 2 and names - manifests == index.Writer._named(meta) | set(meta["retired"])


def test_segments_are_merged(spark, corpus, tmp_path, monkeypatch):
    root, folder = str(tmp_path / "index"), corpus / "-srv-data-web"
    monkeypatch.setattr(index, "SEGMENTS", 1)
    index.refresh(spark, str(corpus), root)
    (folder / "three.jsonl").write_text(line("user", "third gadget") + "\n")
    index.index_file(spark, str(corpus), root, f"file:{folder}/three.jsonl")
    own = index.open_index(spark, root)
    assert len(own.segments) == 1 and own.blocks().count() == 5 and search.search(own, "gadget").count() == 1


def test_two_tiers(spark, corpus, tmp_path):
    folder = corpus / "-srv-data-web"
    own = indexed(spark, corpus, tmp_path)
    (folder / "late.jsonl").write_text(line("user", "a WIDGET of late, widgets", cwd="/srv/x") + "\n")
    both = search.two_tier(own, str(corpus), "widget").collect()
    assert [(r["tier"], r["line_no"]) for r in both] == [(0, 2), (0, 3), (1, 0)]
    assert [(r["start"], r["end"]) for r in both[2]["match_ranges"]] == [(2, 8), (18, 24)]
    assert [r["tier"] for r in search.two_tier(own, str(corpus), "widget", limit=2).collect()] == [0, 0]  # no room, so not looked at
    assert search.two_tier(own, str(corpus), "!").count() == 0


def test_drafts(spark, corpus, tmp_path):
    """Edits, deletions with their partners, undo, and what is saved."""
    path = f"file:{corpus}/-srv-data-web/one.jsonl"
    lines = jsonl.read_lines(spark, str(corpus))
    rows = edit.build_draft(lines)
    assert rows.count() == 14 and {r["row_key"] for r in rows.collect()} >= {"u1", "a1", "u9", "idx:0", "idx:5"}
    blocks = jsonl.content_blocks(jsonl.entries(lines)).select("session_path", "line_no", "content_no", "kind", "tool_id")
    use = blocks.filter("kind = 'tool_use'")
    gone = edit.delete_units(use.limit(0), use, blocks)
    assert sorted((r["line_no"], r["content_no"]) for r in gone.collect()) == [(3, 2), (4, 0)]
    assert edit.undelete(gone, blocks.filter("kind = 'tool_result'"), blocks).count() == 0
    assert edit.delete_blocks(gone, blocks.filter("kind = 'thinking'")).count() == 3
    kept = {r["line_no"]: r["line"] for r in edit.serialize(rows, gone).collect()}
    was = {r["line_no"]: r["line"] for r in rows.collect()}
    assert set(was) - set(kept) == {4} and all(kept[k] == was[k] for k in kept if k != 3) and "tool_use" not in kept[3] and '"hm"' in kept[3]
    edits = spark.createDataFrame([(path, 3, 0, "new 1"), (path, 2, 0, "new 2"), (path, 5, 0, "x"), (path, 2, 4, "x"), (path, 13, 0, "x")], "session_path string, line_no long, text_no int, text string")
    new = edit.edit_texts(rows, edits)
    changed = {r["line_no"] for r in new.collect() if r["line"] != was[r["line_no"]]}
    assert changed == {2, 3}  # repeated keys, broken lines and places that are not there stay
    assert edit.dirty_sessions(new, rows, gone).first()[1:] == (4, True) and edit.dirty_sessions(rows, rows, gone.limit(0)).first()[1:] == (0, False)
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    backup = edit.save(spark, str(corpus), str(tmp_path / "b"), root, path, new, gone)
    assert open(backup.removeprefix("file:")).read().startswith('{"type": "queue') and search.search(index.open_index(spark, root), "new").count() == 2
    assert (corpus / "-srv-data-web" / "one.jsonl").read_text().count("\n") == 13
    copy = edit.save_copy(spark, str(corpus), root, path, new, gone)
    assert "-edited-" in copy and index.open_index(spark, root).files().count() == 2
    fresh, none = edit.discard(lines)
    assert fresh.count() == 13 and none.count() == 0


def test_forks(spark):
    lines = made(spark, {"s": ['{"sessionId":"old","uuid":"u"}', " ", '{"x":{"sessionId":"old"},"sessionId":"old"}', ""]})
    got = {r["line_no"]: r["line"] for r in edit.fork(lines, 2, "a$1").collect()}
    assert got == {0: '{"sessionId":"a$1","uuid":"u"}', 1: " ", 2: '{"x":{"sessionId":"a$1"},"sessionId":"old"}'}
    drawn = uuid.UUID(json.loads(edit.fork(lines, 0).first()["line"])["sessionId"])
    assert drawn.version == 4 and drawn.variant == uuid.RFC_4122
    with pytest.raises(Exception, match="out of range"):
        edit.fork(lines, 3, "x").collect()
    assert {r["line_no"] for r in edit.fork(lines, 3, "x", strict=False).collect()} == {0, 1, 2}  # the break at the end makes no line


def test_turns_of_files(spark):
    """Results, notices and echoes form no turn; an interruption marks the last closed one."""
    rows = [
        line("user", "one"), line("assistant", [{"type": "text", "text": "a"}], requestId="r1"), line("user", [{"type": "tool_result", "tool_use_id": "t"}]),
        line("assistant", [{"type": "text", "text": "b"}], requestId="r1"), line("user", "<task-notification>x"), line("user", "oh [Request interrupted by user]"),
        line("user", [{"type": "image"}]), line("user", "  "),
    ]
    got = sorted((r["turn_id"], r["role"], r["first_line"], r["last_line"], r["interrupted"]) for r in sequence.build_turns(jsonl.view_entries(made(spark, {"s": rows}))).collect())
    assert got == [(1, "user", 0, 0, True), (2, "assistant", 1, 3, False), (3, "user", 6, 6, False)]


def test_texts_of_mixed_blocks(spark):
    """Values of other types than a text's are none."""
    results = [([{"type": "text", "text": "q"}, "z"], "q"), ([{"type": "text", "text": 5}, {"type": "text", "text": "q"}], "q"), ("said", "said"), ([None, 7, {"type": 7, "text": "x"}], ""), ({"text": "x"}, ""), (5, "")]
    rows = [line("user", [{"type": "tool_result", "tool_use_id": "t", "content": c}]) for c, _ in results] + [line("user", [{"type": "text", "text": 7}, {"type": "text", "text": "w"}])]
    own = made(spark, {"s": rows})
    got = {(r["line_no"], r["content_no"]): r["text"] for r in jsonl.content_blocks(jsonl.entries(own)).collect()}
    assert got == {(k, 0): want for k, (_, want) in enumerate(results)} | {(6, 0): "", (6, 1): "w"}
    assert [(r["block_no"], r["text"]) for r in jsonl.search_blocks(own).collect()] == [(1, "w")]


def test_intents_and_briefs(spark):
    from palaver.functions import tools

    rows = [("BashOutput", '{"a":"zz","bash_id":"b7"}', "BashOutput: b7"), ("Skill", '{"skill":"s","x":"y"}', "Skill: s"), ("TodoWrite", '{"todos":[1]}', "TodoWrite: 1 item"), ("Read", '{"file_path":7}', "Read: 7"), ("X", "{}", "X")]
    rows += [("Skill", '{"n":5,"s":"x"}', "Skill: x"), ("Skill", '{"flag":true,"s":"y"}', "Skill: y"), ("Bash", '{"command":{"a":1}}', "Bash"), ("Skill", '{"s":"[1,2]"}', "Skill: [1,2]"), ("Skill", '{"s":"[draft] fix it"}', "Skill: [draft] fix it")]
    rows += [("Bash", '{"command":true,"s":"z"}', "Bash: true"), ("Bash", '{"command":1.50}', "Bash: 1.5"), ("Bash", '{"command":2.0}', "Bash: 2"), ("Bash", '{"command":null,"s":"z"}', "Bash: z"), ("Bash", '{"command":" ","s":"z"}', "Bash: z"), ("TodoWrite", '{"todos":[]}', "TodoWrite: 0 items"), ("Bash", "no json", "Bash"), ("Read", '{"file_path":"100"}', "Read: 100")]
    df = spark.createDataFrame(rows, "n string, i string, want string")
    assert df.filter(tools.tool_intent(F.col("n"), F.col("i")) != F.col("want")).count() == 0
    brief = spark.createDataFrame([("", False), ("x", True), ("y" * 1000, False), ("y" * 1250, False)], "t string, e boolean").select(T.tool_result_brief(F.col("t"), F.col("e")).alias("b"))
    assert [r["b"] for r in brief.collect()] == ["OK · 0 chars", "Error · 1 char", "OK · 1.0k chars", "OK · 1.3k chars"]
    kinds = spark.createDataFrame([(["tool_use", "thinking"], 2), (["unknown"], 1), (["tool_result"] * 2, 3)], "k array<string>, n int")
    assert [r[0] for r in kinds.select(tools.group_summary(F.col("k"), F.col("n"))).collect()] == ["1 tool call · 1 thinking", "1 item", "2 results"]
    note = "<task-notification><task-id>a</task-id><note> n </note><usage><subagent_tokens>12</subagent_tokens><tool_uses>3</tool_uses></usage>"
    got = spark.createDataFrame([(note,)], "t string").select(T.task_notification(F.col("t")).alias("m")).first()["m"]
    assert got == {"task_id": "a", "note": "n", "usage": "subagent_tokens: 12 | tool_uses: 3"}


def test_latest_result_ends_the_one_before(spark):
    from palaver.streaming.cancel import Latest
    from palaver.streaming.refresh import upsert

    one = Latest(spark)
    first = one.rows(spark.range(1000).repartition(8))
    assert next(first) is not None
    assert len(list(one.rows(spark.range(10)))) == 10 and list(first) == []
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, "k", "v").collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_lossless_edits():
    raw = '{"n": 9223372036854775807, "f":1e5, "message":{"content":[{"type":"text","text":"a"},{"type":"thinking","thinking":"x"},{"type":"text", "text":"b"}]} , "1":2}'
    assert edit.edit_text(raw, 1, "né") == raw.replace('"text":"b"', '"text":"né"')
    assert edit.edit_text(raw, 2, "z") == raw and edit.edit_text("no json", 0, "z") == "no json" and edit.edit_text(raw, 0, "a") == raw
    assert json.loads(edit.drop_blocks(raw, {1}))["message"]["content"] == [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]
    assert edit.drop_blocks(raw, set()) == raw and edit.drop_blocks(raw, {0, 1, 2}) is None
    assert edit.drop_blocks("{bad", {0}) == "{bad" and edit.drop_blocks('{"a":1', {0}) == '{"a":1' and edit.edit_text('{"a":1,"a":2}', 0, "x") == '{"a":1,"a":2}'
    once = edit.rename("x", "t", "s")
    assert once.startswith("x\n") and len(edit.rename(once, "u", "s").splitlines()) == 5


def test_turns_match_a_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(60):
        turn, open_request, opened = 0, "", False
        for n in range(rng.randint(1, 12)):
            source, request = rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["", "r1", "r2"])
            rows.append((f"s{s}", n, source, request, "x", n))
            if source == "user":
                turn, opened = turn + 1, False
            elif source == "assistant":
                # a turn keeps the request that it was opened with
                if not opened or request and request != open_request:
                    turn, opened, open_request = turn + 1, True, request
            if source != "system":
                want[(f"s{s}", turn)] = want.get((f"s{s}", turn), 0) + 1
    df = spark.createDataFrame(rows, "session_path string, line_no long, source string, request_id string, text string, ts_ms long")
    assert {(r["session_path"], r["turn_id"]): r["n_rows"] for r in sequence.turns(df).collect()} == want


def test_one_edit(spark):
    pairs = [("abc", "acb", True), ("abc", "abc", True), ("abc", "ab", True), ("abc", "cba", False), ("é", "e", True), ("ab", "ba", True), ("a", "abc", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.filter(T.one_edit(F.col("a"), F.col("b")) != F.col("want")).count() == 0
