"""The index: how it is dealt, what it counts, what is dead in it, and who may write it."""

from __future__ import annotations

import json
import random
import re
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palaver.catalog import QUERIES
from palaver.functions import text as T
from palaver.operators import index, search, segments
from palaver.plans import corpus as plans
from palaver.sources.lease import Lease, Lost
from palaver.sources.store import Store


def said(text, **more):
    return json.dumps({"type": "user", "uuid": "u", "message": {"content": text}, **more}, ensure_ascii=False) + "\n"


@pytest.fixture
def corpus(tmp_path):
    """Sessions of drawn words; nine tenths of the blocks hold ``the``."""
    rng, root = random.Random(4), tmp_path / "projects" / "p"
    root.mkdir(parents=True)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    for k in range(12):
        lines = [said(" ".join((["the"] if rng.random() < 0.9 else []) + rng.choices(words, k=rng.randint(0, 12))), cwd=f"/srv/w{k % 3}") for _ in range(30)]
        (root / f"s{k}.jsonl").write_text("".join(lines))
    return tmp_path / "projects"


def texts(corpus):
    return {(p.name, k): json.loads(x)["message"]["content"] for p in sorted(corpus.rglob("*.jsonl")) for k, x in enumerate(p.read_text().splitlines())}


def counted(corpus):
    """(df, cf) of all words of the present texts."""
    df, cf = Counter(), Counter()
    for text in texts(corpus).values():
        own = re.findall(r"[^\W_]+", text.lower())
        df.update(set(own))
        cf.update(own)
    return {w: (df[w], cf[w]) for w in df}


def vocabulary(own):
    return {r["term"]: (r["df"], r["cf"]) for r in own.vocabulary().collect()}


def test_frequent_words_span_parts(spark, corpus, tmp_path, monkeypatch):
    """A word of nine tenths of the blocks fills no part; each part is one file, found again by its key."""
    monkeypatch.setattr(segments, "PART_ROWS", 64)
    monkeypatch.setattr(segments, "PART_BYTES", 4096)
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    own = index.open_index(spark, root)
    [(name, entry)] = own.segments.items()
    posts = spark.read.parquet(f"{root}/{name}/postings")
    sizes = {r["part"]: r["count"] for r in posts.groupBy("part").count().collect()}
    the = posts.filter("term = 'the'").groupBy("part").count().collect()
    assert entry["postings"] == -(-posts.count() // 64) and entry["blocks"] > 1 and entry["dictionary"] > 1
    assert len(the) > 2 and max(r["count"] for r in the) < 2 * 64 and max(sizes.values()) < 4 * 64
    for table in ("postings", "blocks", "dictionary"):
        files = Counter(p.parent for p in (tmp_path / "index" / name / table).rglob("part-*.parquet"))
        assert set(files.values()) == {1}, table  # a part is written by one task
    assert vocabulary(own) == counted(corpus)
    df = counted(corpus)["the"][0]
    assert search.matches(own, "the").count() >= df  # and neighbours
    assert search.summary(own, "the", limit=5).first()["scanned"] == search.matches(own, "the").count()


def test_postings_are_counted_row_by_row(spark):
    rows = [("s", 0, 0, "b a b, B c"), ("s", 1, 0, "…"), ("s", 2, 0, "x " * 5000)]
    found = segments.postings(spark.createDataFrame(rows, "session_path string, line_no long, block_no long, text string"))
    assert sorted((r["line_no"], r["term"], r["tf"], r["dl"]) for r in found.collect()) == [(0, "a", 1, 5), (0, "b", 3, 5), (0, "c", 1, 5), (2, "x", 5000, 5000)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_found_by_keys(spark, corpus, tmp_path):
    """All terms one insertion, deletion, substitution or swap away, against every term; by an equi-join."""
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    own = index.open_index(spark, root)
    terms = spark.createDataFrame([(w,) for w in counted(corpus)], "term string")
    rng = random.Random(9)
    words = ["the", "teh", "hte", "th", "thé", "zzzz", "of"] + ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    words += [w[:1] + w[2:3] + w[1:2] + w[3:] for w in rng.sample(sorted(counted(corpus)), 30)]  # two letters swapped
    asked = spark.createDataFrame(list(enumerate(words)), "tok int, word string")
    near = (F.length("word") >= 3) & T.one_edit(F.col("word"), F.col("term"))
    want = {(r["tok"], r["term"]) for r in terms.join(asked, (F.col("word") == F.col("term")) | near).collect()}
    found = search.neighbours(own, words)
    assert {(r["tok"], r["term"]) for r in found.collect()} == want and len(want) > 60
    plan = search.neighbours(own, ["teh"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "PushedFilters: [In(key" in plan.replace("EqualTo(key", "In(key")


def test_dead_sessions_are_bits(spark, corpus, tmp_path):
    """After edits and deletions counts and hits are those of the present texts; no search joins the table of files."""
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    before = index.open_index(spark, root)
    assert "dead" not in next(iter(before.segments.values())) and before.meta["dead"] is None
    (corpus / "p" / "s3.jsonl").write_text(said("the only gadget, the gadgets") * 3)
    (corpus / "p" / "s5.jsonl").unlink()
    assert index.refresh(spark, str(corpus), root) == {"changed": 1, "deleted": 1, "unchanged": 10}
    own = index.open_index(spark, root)
    assert [m.get("dead") for m in own.segments.values()] == [2, None] and own.vectors().count() >= 1
    assert vocabulary(own) == counted(corpus)
    assert own.blocks().count() == len([t for t in texts(corpus).values() if t.strip()])
    assert search.matches(own, "gadget").count() == 3 and not [r for r in search.matches(own, "the").collect() if "s5" in r["session_path"]]
    plan = search.matches(own, "gadget")._jdf.queryExecution().executedPlan().toString()
    assert own.meta["files"] not in plan and plan.count("dead-") == 0  # the segment that holds it has none dead
    assert own.meta["files"] not in search.matches(own, "the", search.Filters(projects=["/srv/w1"]))._jdf.queryExecution().executedPlan().toString()
    (corpus / "p" / "s3.jsonl").write_text(said("neither"))
    index.index_file(spark, str(corpus), root, f"file:{corpus}/p/s3.jsonl")
    own = index.open_index(spark, root)
    assert vocabulary(own) == counted(corpus) and len(own.segments) == 2  # the one that is all dead went
    fresh = str(tmp_path / "other")
    index.refresh(spark, str(corpus), fresh)
    score = lambda i: sorted(map(tuple, search.matches(i, "the neither").collect()))
    assert score(own) == score(index.open_index(spark, fresh))


def test_merges_take_the_smaller_segments(spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENTS", 3)
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    large = next(iter(index.open_index(spark, root).segments))
    for k in range(4):
        (corpus / "p" / "late.jsonl").write_text(said(f"late the {k}"))
        (corpus / "p" / f"more{k}.jsonl").write_text(said(f"more the {k}"))
        index.refresh(spark, str(corpus), root)
        own = index.open_index(spark, root)
        assert len(own.segments) <= 3 and large in own.segments
        assert vocabulary(own) == counted(corpus)


def test_waves_publish_as_they_go(spark, corpus, tmp_path, monkeypatch):
    """Progress can be read while a build runs, and a build that is ended goes on where it was."""
    root, seen, wave = str(tmp_path / "index"), [], index.Writer.wave

    def slow(self, *args):
        seen.append(index.status(spark, str(corpus), root))
        if len(seen) == 3:
            raise KeyboardInterrupt
        wave(self, *args)

    monkeypatch.setattr(index.Writer, "wave", slow)
    size = sum(p.stat().st_size for p in corpus.rglob("*.jsonl"))
    with pytest.raises(KeyboardInterrupt):
        index.refresh(spark, str(corpus), root, wave_bytes=size // 4)
    done = [s["indexed_sessions"] for s in seen]
    assert done[0] == 0 < done[1] < done[2] < 12 and all(s["building"] and s["total_sessions"] == 12 for s in seen)
    monkeypatch.setattr(index.Writer, "wave", wave)
    counts = index.refresh(spark, str(corpus), root)
    assert counts == {"new": 12 - done[2], "unchanged": done[2]} and vocabulary(index.open_index(spark, root)) == counted(corpus)
    assert not index.status(spark, str(corpus), root)["building"]


def test_versions(spark, corpus, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    monkeypatch.setattr(index, "ENGINE", "x")
    assert index.open_index(spark, root).empty and list((tmp_path / "index").glob("_meta-*"))  # a reader removes nothing
    assert index.build(spark, str(corpus), root)["new"] == 12
    assert len(index.open_index(spark, root).segments) == 1


def test_a_live_writer_keeps_the_lease(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    with Lease(store, lease_s=0.6) as own:
        with pytest.raises(TimeoutError), Lease(store, wait_s=2.0, lease_s=0.6):
            pass
        own.check()
        assert own.beats > 0
    with Lease(store, wait_s=1, lease_s=0.6) as again:
        again.check()
    assert not list(tmp_path.glob("_lock-*"))


def test_a_silent_writer_is_robbed_and_cannot_publish(spark, corpus, tmp_path, monkeypatch):
    """Its heartbeat stops; another takes over with a higher token; what the first wrote is not seen."""
    root = str(tmp_path / "index")
    index.refresh(spark, str(corpus), root)
    (corpus / "p" / "late.jsonl").write_text(said("late gadget"))
    publish, robbed = index.Writer._publish, []

    def stalled(self, *args):
        if not robbed:
            robbed.append(self.lease.token)
            self.lease.stop()
            monkeypatch.setattr("palaver.sources.lease.LEASE_S", 0.5)
            assert index.refresh(spark, str(corpus), root) == {"new": 1, "unchanged": 12}
        return publish(self, *args)

    monkeypatch.setattr(index.Writer, "_publish", stalled)
    with pytest.raises(Lost):
        index.refresh(spark, str(corpus), root)
    own = index.open_index(spark, root)
    assert own.meta["token"] == robbed[0] + 1 and own.meta["number"] == 2 and search.search(own, "gadget").count() == 1
    assert index.refresh(spark, str(corpus), root) == {"unchanged": 13}


def test_a_state_of_an_older_token_is_never_the_present_one(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for token, number in ((2, 3), (1, 9), (2, 2)):
        store.write(f"_meta-{token:012d}-{number:012d}.json", json.dumps({"version": index.version(), "token": token, "number": number}))
    assert (index.open_index(spark, str(tmp_path)).meta["token"], index.open_index(spark, str(tmp_path)).meta["number"]) == (2, 3)


def test_only_one_of_many_waiters_takes_over(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("_lock-000000000007", "dead 1")
    held, order = [], []

    def work(k):
        with Lease(Store(spark, str(tmp_path)), wait_s=30, lease_s=0.8) as own:
            held.append(k)
            order.append(own.token)
            time.sleep(0.3)
            assert held == [k]
            held.clear()

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(order) == 3 and order[0] == 8 and not held


def test_the_fragment_that_tells_most_is_shown(spark):
    """A rare word late in the text beats a dull one at its start; held against fragments cut by a loop."""
    weights = {"the": 100, "gadget": 9000, "thé": 50}

    def brute(text, most=240):
        tokens = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", text)]
        parts, start, own = [], 0, []
        for a, z, w in tokens:
            if z - start > most:
                parts.append((start, own))
                start, own = a, []
            own.append((z, w))
        parts.append((start, own))
        best = max(((sum(weights.get(w, 0) for _, w in own), -start, own[-1][0] if own else 0) for start, own in parts), default=(0, 0, 0))
        return text[-best[1] : best[2]] if best[0] else text[:most]

    rng = random.Random(6)
    long = "the " + "dull words " * 100 + "a gadget, and the end. " + "more " * 90
    texts = [long, "", "...", "no such word", "x" * 500 + " gadget", "gadget " + "y" * 300 + " gadget gadget", "  the gadget  "]
    texts += [" ".join(rng.choices(["the", "gadget", "Thé", "İx", "lorem", "—", "ipsum" * 9], k=rng.randint(0, 200))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", T.best_fragment(F.col("t"), weights).alias("f"))
    got = {r["k"]: r["f"] for r in rows.collect()}
    assert "gadget" in got[0] and got == {k: brute(t) for k, t in enumerate(texts)}


def test_a_refresh_takes_a_condition(spark, tmp_path, monkeypatch):
    """Sessions outside of the condition are neither read nor taken for deleted; the query names none on the driver."""
    root, own = str(tmp_path / "some"), tmp_path / "corpus" / "p"
    own.mkdir(parents=True)
    for k in range(6):
        (own / f"{k}.jsonl").write_text(json.dumps({"type": "user", "message": {"content": f"word{k}"}}) + "\n")
    number = F.regexp_extract("session_path", r"(\d+)\.jsonl$", 1).cast("int")
    assert index.refresh(spark, str(own.parent), root, number < 4) == {"new": 4}
    (own / "1.jsonl").unlink()
    assert index.refresh(spark, str(own.parent), root, number >= 3) == {"new": 2, "unchanged": 1}
    assert index.refresh(spark, str(own.parent), root, number < 3) == {"deleted": 1, "unchanged": 2}
    assert index.open_index(spark, root).files().count() == 5
    asked, real = [], index.refresh
    monkeypatch.setattr(index, "refresh", lambda spark, corpus, root, paths=None, *more: asked.append(paths) or real(spark, corpus, root, paths, *more))
    monkeypatch.setattr(plans, "_known", {})
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(c, 0, "user", "x") for c in range(10)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{sf}/conversations.parquet")
    assert tuple(QUERIES["index_status"](spark, sf).first()) == (8, 2)
    assert len(asked) == 1 and not isinstance(asked[0], list)
