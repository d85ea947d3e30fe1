"""Fixtures of the data model, worked by hand, and properties."""

import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom import errors, tools
from threadloom.config import EngineConfig
from threadloom.errors import EngineError
from threadloom.functions import text as T
from threadloom.functions import tokens
from threadloom.operators import compact, context, dag, expand, files, ingest, integrity, search, search_index, session
from threadloom.sources.model import SCHEMAS, Store
from threadloom.streaming.ingest import ingest_stream

T0 = datetime.datetime(2024, 1, 1, 10)
MESSAGE = SCHEMAS["messages"]
ARRIVAL = "id string, conversation_id string, role string, content string, arrival long, created_at timestamp"


def msgs(spark, n, conv="a", texts=None, tokens=None):
    rows = []
    for i in range(n):
        text = texts[i] if texts else f"message {i}"
        rows.append((f"{conv}-{i + 1}", conv, "user" if i % 2 == 0 else "assistant", text, tokens[i] if tokens else -(-len(text) * 2 // 7), i + 1, T0 + datetime.timedelta(minutes=i)))
    return spark.createDataFrame(rows, MESSAGE)


def sums(spark, rows):
    """(id, depth, tokens[, conv])"""
    out = [(r[0], r[3] if len(r) > 3 else "a", r[1], f"content {r[0]}", r[2], T0 + datetime.timedelta(seconds=k), "normal") for k, r in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMAS["summaries"])


def tables(spark, messages=None, summaries=(), edges=(), links=()):
    return {
        "messages": messages if messages is not None else spark.createDataFrame([], MESSAGE),
        "summaries": sums(spark, list(summaries)),
        "summary_parents": spark.createDataFrame(list(edges), SCHEMAS["summary_parents"]),
        "summary_messages": spark.createDataFrame([(s, m, k) for k, (s, m) in enumerate(links)], SCHEMAS["summary_messages"]),
    }


def arrivals(spark, rows):
    return spark.createDataFrame([(i, c, r, t, k, T0) for k, (i, c, r, t) in enumerate(rows)], ARRIVAL)


def numbered(df):
    return sorted((r.conversation_id, r.sequence_number, r.id, r.content) for r in df.collect())


def test_first_arrival_wins_and_no_gaps(spark):
    batch = arrivals(spark, [("m1", "a", "user", "one"), ("m1", "a", "user", "again"), ("x", "a", "robot", "bad role"), ("y", "a", "user", None), ("m2", "a", "assistant", "two"), ("m1", "b", "user", "foreign"), ("m3", "a", "user", "three")])
    got = ingest.persist_messages(spark.createDataFrame([], MESSAGE), batch)
    assert numbered(got) == [("a", 1, "m1", "one"), ("a", 2, "m2", "two"), ("a", 3, "m3", "three")]
    more = ingest.persist_messages(got, arrivals(spark, [("m2", "a", "user", "late"), ("m4", "a", "user", "four")]))
    assert numbered(more) == [("a", 4, "m4", "four")]
    assert ingest.persist_messages(got, batch).count() == 0


def test_parts(spark):
    content = '[{"type":"text","text":" A "},{"type":"tool_use","content":"B"},{"type":5},{"type":"tool_result","content":"  "}]'
    df = spark.createDataFrame([("m", content), ("p", "plain"), ("o", '{"type":"text"}'), ("e", "[]"), ("b", "[not json")], "id string, content string")
    got = {(r.message_id, r.sequence_number): (r.part_type, r.content) for r in ingest.message_parts(df).collect()}
    assert got[("m", 1)] == ("text", " A ") and got[("m", 2)] == ("tool_use", "B")
    assert got[("p", 1)] == ("text", "plain") and got[("o", 1)] == ("text", '{"type":"text"}') and got[("e", 1)] == ("text", "[]") and got[("b", 1)] == ("text", "[not json")
    odd = ['[5, "a", {"a":1}]', '["a", {"type":"text","text":"kept"}]', '[{"type":7,"content":"x"},{"type":"","text":"x"},{"type":"t","content":3,"text":"y"}]', "[1,2]", "5", '"text"', ' [{"type":"text","text":"led"}]', '[[{"type":"text","text":"deep"}]]']
    rows = spark.createDataFrame([(x,) for x in odd], "c string").select(T.parse_parts("c").alias("p")).collect()
    assert [[tuple(x) for x in r.p] for r in rows] == [[("text", odd[0])], [("text", "kept")], [("t", "y")], [("text", "[1,2]")], [("text", "5")], [("text", '"text"')], [("text", "led")], [("text", odd[7])]]
    assert df.filter("id = 'm'").select(T.join_parts(T.parse_parts("content")).alias("t")).first().t.split("\n\n")[:2] == ["A", "B"]


def test_search_fixtures(spark):
    texts = [f"talk about {w}" for w in ["setup", "paths", "Authentication flow", "tests", "café culture", "deploy", "logs", "authentication tokens", "foo_bar", "done"]]
    m = msgs(spark, 10, texts=texts)
    ids = lambda q: sorted(r.id for r in search.ranked(m, q).collect())
    assert ids("authentication") == ["a-3", "a-8"]
    assert ids('"authentication flow"') == ["a-3"] and ids("auth*") == ["a-3", "a-8"] and ids("cafe") == ["a-5"] and ids("foo_bar") == ["a-9"]
    assert ids("authentication NOT flow") == ["a-8"] and ids("flow OR (foo AND bar)") == ["a-3", "a-9"]
    assert ids("what's up?") == [] and ids("src/authentication.ts") == [] and ids("") == []
    ranks = [r.rank for r in search.top(search.ranked(m, "authentication OR talk")).collect()]
    assert ranks == sorted(ranks) and len(ranks) == 10
    snip = m.filter("id = 'a-3'").select(search.snippet("content", "authentication").alias("s")).first().s
    assert snip == "talk about <b>Authentication</b> flow"


def test_bm25_equals_fts(spark, tmp_path):
    import sqlite3

    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]) for _ in range(rnd.randint(3, 30))) for _ in range(60)] + ["rare alpha word", "another rare one"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(content)")
    con.executemany("insert into t(rowid, content) values (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    store = Store(spark, str(tmp_path / "store"))
    rows = df.select(F.col("id").cast("string").alias("id"), F.lit("c").alias("conversation_id"), "content")
    search_index.insert(store, "message", rows.filter("cast(id as int) < 20"))
    search_index.insert(store, "message", rows)
    search_index.insert(store, "message", rows)
    near = ("NEAR(alpha beta, 2)", 'NEAR("alpha beta" gamma, 3) OR rare', "^alpha", '^"alpha beta" OR rare', "content : alpha beta", "content : (alpha OR beta) NOT eta", "{content} : zeta", "alpha + beta", "rare OR - content : alpha", "NEAR(alpha beta gamma, 4)", "NEAR(iota) AND alpha", "NEAR(alpha eps)")
    for query in (*near, "rare", "rare OR kappa", "alpha beta", '"alpha beta" OR zeta', "rar* OR iota NOT eta", "alpha AND (beta OR gamma)"):
        want = dict(con.execute("select rowid, bm25(t) from t where t match ?", (query,)).fetchall())
        got = {r.id: r["rank"] for r in search.ranked(df, query).collect()}
        assert set(got) == set(want), query
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want), query
        kept = {int(r.id): r["rank"] for r in search_index.search_all(store, query, "message", 1000).collect()}
        assert set(kept) == set(want) and all(abs(kept[k] - want[k]) < 1e-6 for k in want), query
    assert integrity.index_mismatches({"messages": rows, "summaries": rows.limit(0)}, search_index.indexed_ids(store)).count() == 0
    search_index.rebuild(store, rows.limit(5), rows.limit(3))
    assert search_index.indexed_ids(store).count() == 8


def test_dag_fixture(spark):
    before = tables(spark, summaries=[("l1", 0, 5), ("l2", 0, 5), ("l3", 0, 5)])
    assert dag.leaves(before["summaries"], before["summary_parents"]).count() == dag.roots(before["summaries"], before["summary_parents"]).count() == 3
    t = tables(spark, msgs(spark, 9), [("l1", 0, 5), ("l2", 0, 5), ("l3", 0, 5), ("p", 1, 5)], [(f"l{k}", "p") for k in (1, 2, 3)], [(f"l{1 + i // 3}", f"a-{i + 1}") for i in range(9)])
    assert dag.leaves(t["summaries"], t["summary_parents"]).count() == 0
    assert [r.id for r in dag.roots(t["summaries"], t["summary_parents"]).collect()] == ["p"]
    assert dag.tree(t["summaries"], t["summary_parents"]).count() == 4
    cover = {r.id: (r.first_seq, r.last_seq, r.n_messages) for r in dag.coverage(t["summaries"], t["summary_parents"], t["summary_messages"], t["messages"]).collect()}
    assert cover == {"l1": (1, 3, 3), "l2": (4, 6, 3), "l3": (7, 9, 3), "p": (1, 9, 9)}
    report = integrity.run_checks(t, EngineConfig())
    assert {r.name: r.status for r in report.collect()} == {n: "pass" for n in ("message-ordering", "summary-coverage", "dag-acyclicity", "depth-consistency", "orphan-detection", "token-budget")}


def test_integrity_faults(spark):
    m = msgs(spark, 4).filter("sequence_number <> 3")
    t = tables(spark, m, [("x", 0, 5), ("y", 3, 5)], [("x", "y"), ("y", "x")], [("x", "a-1"), ("x", "gone"), ("none", "a-2")])
    found = {r.name: (r.status, r.n_bad) for r in integrity.run_checks(t, EngineConfig()).collect()}
    assert found["message-ordering"] == ("fail", 1) and found["dag-acyclicity"] == ("fail", 2) and found["depth-consistency"][0] == "fail" and found["summary-coverage"] == ("fail", 2)
    fixed, gone = integrity.repair(t)
    assert gone.count() == 2 and [tuple(r)[:2] for r in fixed["summary_messages"].collect()] == [("x", "a-1")]


@pytest.mark.parametrize(("depth", "level"), [(0, "normal"), (3, "aggressive"), (5, "deterministic")])
def test_levels(spark, depth, level):
    t = tables(spark, msgs(spark, 2), [("s", depth, 10)])
    assert compact.state(t, EngineConfig()).first().level == level


def test_thresholds_and_condense(spark):
    assert EngineConfig().thresholds() == (4800, 108_000)
    with pytest.raises(ValueError):
        EngineConfig(max_context_tokens=0)
    t = tables(spark, msgs(spark, 2), [(f"s{k}", 0, 25) for k in range(6)])
    config = EngineConfig()
    made, edges = compact.condense(t, 0, compact.state(t, config), config)
    assert made.count() == 1 and made.first().depth == 1 and edges.count() == 6


def test_soft_blocks_hard_forces(spark):
    m = msgs(spark, 25, tokens=[36 if i % 2 == 0 else 43 for i in range(25)])
    t = tables(spark, m)
    assert not compact.state(t, EngineConfig(soft_token_threshold=5000, hard_token_threshold=8000)).first().due
    hard = EngineConfig(max_context_tokens=1000, soft_token_threshold=500, hard_token_threshold=800, leaf_summary_budget=300)
    out = compact.compact(t, hard)
    assert {r.compaction_level for r in out["summaries"].filter("depth = 0").collect()} == {"aggressive"}
    assert session.open_messages(out).count() == 0
    assert integrity.run_checks(out, hard).filter("status = 'fail' and name <> 'orphan-detection'").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.booleans()), max_size=30), st.integers(0, 100))
def test_chunks_keep_order_and_bound(rows, target):
    out = compact.chunk_numbers([c for c, _ in rows], [u for _, u in rows], target)
    assert len(out) == len(rows) and all(b - a in (0, 1) for a, b in zip(out, out[1:], strict=False)) and (not out or out[0] == 0)
    if target > 0:
        for k in set(out):
            costs = [c for (c, _), n in zip(rows, out, strict=True) if n == k]
            assert len(costs) == 1 or sum(costs) <= -(-11 * target // 10) + 1e-9


def test_chunk_bound_is_exact():
    """A tenth over 100 is 110, not the 111 that 1.1 * 100 rounds up to."""
    assert compact.chunk_numbers([1, 1, 49, 60], [False] * 4, 100) == [0, 0, 0, 1]


def test_chunk_fixture(spark):
    assert compact.chunk_numbers([50] * 6, [True, False] * 3, 100) == [0, 0, 1, 1, 2, 2]


def test_tail_and_packing(spark):
    m = msgs(spark, 10, tokens=[5] * 10)
    assert sorted(r.sequence_number for r in context.fresh_tail(m, 4, 100).collect()) == [7, 8, 9, 10]
    assert sorted(r.sequence_number for r in context.fresh_tail(m, 4, 12).collect()) == [9, 10]
    t = tables(spark, summaries=[("root-1", 2, 10), ("root-2", 1, 10), *[(f"leaf-{k}", 0, 10) for k in range(1, 5)]])
    assert sorted(r.id for r in context.pack_summaries(t["summaries"], t["summary_parents"], F.lit(40)).collect()) == ["leaf-1", "leaf-2", "root-1", "root-2"]
    assert context.pack_summaries(t["summaries"], t["summary_parents"], F.lit(0)).count() == 0
    five = tables(spark, msgs(spark, 5, tokens=[5000] * 5), [("s1", 0, 100), ("s2", 0, 100)])
    items = context.assemble(five, EngineConfig(max_context_tokens=15_000))
    assert context.token_totals(items).first().tokens <= 15_000
    assert {r.id for r in items.collect()} >= {"a-5", "a-4"} and "a-1" not in {r.id for r in items.collect()}


def test_relevance(spark):
    t = tables(spark, msgs(spark, 3, texts=["TypeScript compaction here", "nothing", "TypeScript"]), [("s", 0, 5)])
    got = {r.id: r.relevance for r in context.assemble(t, EngineConfig(), "TypeScript compaction").collect()}
    assert got["a-1"] > 0.5 and got["a-2"] == 0.5 and got["s"] == 0.25
    assert {r.relevance for r in context.assemble(t, EngineConfig()).collect()} == {1.0}


def test_render(spark):
    t = tables(spark, msgs(spark, 26), [("s", 1, 1200)], links=[("s", "a-5"), ("s", "a-25")])
    rows = context.render(context.assemble(t, EngineConfig(fresh_tail_size=1)), t["summary_messages"], t["messages"]).collect()
    text = next(r.text for r in rows if r.text.startswith("<context_summary"))
    assert 'depth="1"' in text and 'tokens="1200"' in text and 'covers_messages="5-25"' in text
    label = lambda ids: spark.range(1).select(T.covered_label(F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")).alias("x")).first().x
    assert label(["7"]) == "7" and label(["b", "1"]) == "2 messages" and label([]) == "0 messages"


def test_ranges_and_targets(spark):
    m = msgs(spark, 20)
    shown = [expand.range_texts(m, a, b).first().text for a, b in ((10, 15), (18, 25), (50, 60))]
    assert [t.count("[#") for t in shown] == [6, 3, 0] and shown[2] == "No messages found in range 50-60 for this session."
    assert shown[1].startswith("=== Messages 18-25 ===\n\n[#18 assistant | 2024-01-01T10:17:00.000Z]\nmessage 17\n\n---\n\n[#19 user")
    assert expand.classify("messages:3-9") == ("range", (3, 9)) and expand.classify("messages:x")[0] == "error" and expand.classify(" ")[0] == "error"
    assert expand.classify("0E8400E2-9b1d-41d4-a716-446655440000")[0] == "summary" and expand.classify("what now")[0] == "search"
    t = tables(spark, m, [("c1-d0-0", 0, 5), ("p", 1, 5)], [("c1-d0-0", "p")], [("c1-d0-0", "a-1")])
    text = lambda conv, target, **k: expand.expand(t, conv, target, **k).first().text
    head = "=== Expanded: Summary c1-d0-0 (depth 0) ===\n\nSummary text:\ncontent c1-d0-0\n\nCovers messages: 1-1 (1 messages)"
    assert text("a", "C1-D0-0") == f"{head}\n\nOriginal message content:\n\n[#1 user] message 0" and text("a", "c1-d0-0", condensed=True) == head
    assert text("b", "c1-d0-0") == "Summary not found: c1-d0-0" and text("b", "messages:1-2").startswith("No messages found") and text("b", "message").startswith("No results found")
    assert text("a", "messages:x").startswith("Invalid message range format")
    assert text("a", "message NOT 5") == 'No results found for: "message NOT 5"' or text("a", "message NOT 5").count("[Message #") == 5


def test_sections_that_do_not_fit_are_left_out(spark):
    """Head and children one by one, messages up to the first that does not fit."""
    kids = [("k1", 0, 5), ("k2", 0, 5), ("k3", 0, 5)]
    t = tables(spark, msgs(spark, 4, texts=["m" * 20, "n" * 400, "o" * 5, "p" * 5]), [("p", 1, 5), *kids], [(k, "p") for k, *_ in kids], [("p", f"a-{i}") for i in range(1, 5)])
    t["summaries"] = t["summaries"].withColumn("content", F.when(F.col("id") == "k2", F.repeat(F.lit("z"), 300)).otherwise(F.col("content")))
    ids = spark.createDataFrame([("p",)], "id string")
    got = expand.summary_texts(t, ids, chars=330).first().text
    assert "id=k1" in got and "id=k2" not in got and "id=k3" in got
    assert got.endswith("Original message content:\n\n[#1 user] " + "m" * 20 + "\n\n... (3 more messages not shown)")


def test_files(spark):
    text = "src/main/app.ts\n" + "word " * 300
    m = msgs(spark, 2, texts=[text, "small"])
    kept, stored = files.offload(m, 100)
    assert stored.first().content == text and stored.first().original_path == "src/main/app.ts"
    by = {r.id: r for r in kept.collect()}
    assert by["a-1"].content.startswith("[Large file: src/main/app.ts (") and by["a-1"].token_count < 100 and by["a-2"].content == "small"
    cases = {
        '<file path="a/b.py">x': "a/b.py", "```ts\n// lib/x.ts\ncode": "lib/x.ts", "```ts\n// path: src/foo.ts": "src/foo.ts", "```md\n# v1.0": None, "```\n/* a.c */": None,
        "```\n  // late.ts": None, "```js\n//x.test.js?y": "x.test.js", "no path\nhere": None, "a/b\tc.txt \nrest": "a/b\tc.txt", "win\\x.c": "win\\x.c", "a/b.toolongextension": None, "a b/c.d": None, "plain.txt": None,
    }
    paths = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select(T.detect_path("t").alias("p"))
    assert [r.p for r in paths.collect()] == [*cases.values(), None]


def test_reset_and_stats(spark):
    t = tables(spark, msgs(spark, 4).unionByName(msgs(spark, 3, "b")), [("s", 0, 7), ("sb", 0, 7, "b")], [], [("s", "a-1"), ("sb", "b-1")])
    left, counts = ingest.reset(t, spark.createDataFrame([("a",)], "conversation_id string"))
    row = counts.first()
    assert (row.n_messages, row.n_summaries) == (4, 1)
    assert left["messages"].count() == 3 and left["summaries"].count() == 1 and [r.summary_id for r in left["summary_messages"].collect()] == ["sb"]
    info = {r.conversation_id: (r.n_messages, r.n_summaries, r.max_depth) for r in session.info(t).collect()}
    assert info == {"a": (4, 1, 0), "b": (3, 1, 0)}
    assert "Messages: 4" in next(r.text for r in session.report(session.describe(t, EngineConfig())).collect() if r.text.startswith("Conversation: a"))


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"m{i % 37}", "abc"[i % 3], "user", f"text {i}", i, T0) for i in range(90)]
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], ARRIVAL).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    store = Store(spark, str(tmp_path / "store"))
    for k in (0, 1, 2, 1):
        stream = spark.readStream.schema(ARRIVAL).parquet(str(tmp_path / "in" / f"b{k}"))
        ingest_stream(store, stream, str(tmp_path / f"c{k}-{random.random()}")).awaitTermination()
        # a restart: the store is opened anew
        store.close()
        with pytest.raises(EngineError):
            store.read("messages")
        store = Store(spark, str(tmp_path / "store"))
    assert len(store.parts["messages"]) <= 3 and store.number <= 3
    whole = ingest.persist_messages(spark.createDataFrame([], MESSAGE), spark.createDataFrame(rows, ARRIVAL))
    assert numbered(store.read("messages")) == numbered(whole)
    assert store.read("conversations").count() == 3


def test_store_commits_recover_and_conflict(spark, tmp_path):
    folder = str(tmp_path / "s")
    one = Store(spark, folder)
    one.commit({"messages": msgs(spark, 2)}, {"summaries": sums(spark, [("x", 0, 1)])})
    two = Store(spark, folder)
    assert two.number == 1 and two.read("messages").count() == 2 and two.read("summaries").count() == 1 and two.read("large_files").count() == 0
    two.append("messages", msgs(spark, 3, "b"))
    with pytest.raises(EngineError) as e:
        one.write("messages", msgs(spark, 1))
    assert e.value.code == "STORE_CONFLICT" and e.value.recoverable
    one.refresh()
    one.rewrite("messages")
    assert len(one.parts["messages"]) == 1 and Store(spark, folder).read("messages").count() == 5
    (tmp_path / "s" / "_commits" / "000000000009.json").write_text('{"schema": 1, "tab')
    again = Store(spark, folder)
    assert again.recovered == ["000000000009.json"] and again.number == 3 and again.read("messages").count() == 5
    (tmp_path / "s" / "_commits" / "000000000010.json").write_text('{"schema": 99, "tables": {}}')
    with pytest.raises(EngineError):
        Store(spark, folder)


def compacted(messages, config):
    """One conversation by the rules, step by step: messages (id, tokens, user, text), all open. Summaries as (depth, level, text, children)."""
    made, open_ = [], list(messages)
    soft, hard = config.thresholds()
    est = lambda t: -(-len(t) * 2 // 7)
    tops = lambda: [s for s in made if not s["up"]]

    def level():
        load = sum(m[1] for m in open_) + sum(est(s["text"]) for s in tops())
        deep = max((s["depth"] for s in tops()), default=0)
        return ("deterministic" if deep >= config.max_summary_depth else "aggressive" if load >= hard or deep >= config.aggressive_threshold else "normal"), load

    now, load = level()
    due = now == "aggressive" or ((len(open_) >= config.summarize_after_messages or sum(m[1] for m in open_) >= config.summarize_after_tokens) and load >= soft)
    if open_ and now != "deterministic" and due:
        chunk = compact.chunk_numbers([max(1, m[1]) for m in open_], [m[2] for m in open_], config.leaf_summary_budget)
        for k in sorted(set(chunk)):
            texts = [m[3] for m, c in zip(open_, chunk, strict=True) if c == k]
            made.append({"depth": 0, "level": now, "text": compact.first_words(texts, 0, now), "up": False})
        open_ = []
    for depth in range(config.max_summary_depth):
        below = [s for s in made if s["depth"] == depth and not s["up"]]
        if len(below) < config.min_condense:
            continue
        now, nxt = level()[0], depth + 1
        own = "aggressive" if now == "aggressive" else "deterministic" if nxt >= config.max_summary_depth else "aggressive" if nxt >= config.aggressive_threshold else "normal"
        made.append({"depth": nxt, "level": own, "text": compact.first_words([s["text"] for s in below], nxt, own), "up": False})
        for s in below:
            s["up"] = True
    if level()[0] == "deterministic":
        leaves = [s for s in made if s["depth"] == 0 and not s["up"]]
        while leaves and sum(est(s["text"]) for s in leaves) > config.condensed_summary_budget:
            made.remove(leaves.pop(0))
    return sorted((s["depth"], s["level"], s["text"]) for s in made)


def test_compaction_against_the_rules(spark):
    rnd = random.Random(5)
    rows, by = [], {}
    for c in range(12):
        for i in range(rnd.choice([1, 3, 8, 30])):
            text = " ".join(rnd.choice(["red", "green", "blue"]) + str(i) for _ in range(rnd.randint(1, 60)))
            by.setdefault(f"c{c}", []).append((f"c{c}-{i}", -(-len(text) * 2 // 7), i % 2 == 0, text))
            rows.append((f"c{c}-{i}", f"c{c}", "user" if i % 2 == 0 else "assistant", text, -(-len(text) * 2 // 7), i + 1, T0 + datetime.timedelta(minutes=i)))
    config = EngineConfig(max_context_tokens=800, soft_token_threshold=200, hard_token_threshold=600, leaf_summary_budget=120, summarize_after_messages=3, summarize_after_tokens=200, min_condense=2, max_summary_depth=3, aggressive_threshold=2)
    out, result = compact.run(tables(spark, spark.createDataFrame(rows, MESSAGE)), config)
    got = {}
    for r in out["summaries"].collect():
        got.setdefault(r.conversation_id, []).append((r.depth, r.compaction_level, r.content))
    assert {c: sorted(v) for c, v in got.items()} == {c: v for c in by if (v := compacted(by[c], config))}
    assert {r.conversation_id: r.n_created for r in result.collect()} == {c: len(got.get(c, [])) for c in by}


def test_condensing_passes_over_a_depth(spark):
    """A depth with too few summaries does not end the schedule."""
    t = tables(spark, msgs(spark, 2), [("l", 0, 5), *[(f"s{k}", 2, 5) for k in range(6)]])
    out = compact.compact(t, EngineConfig())
    assert sorted(r.depth for r in out["summaries"].collect()) == [0, 2, 2, 2, 2, 2, 2, 3]


def test_deep_and_shared_dags(spark):
    chain = [(f"s{k}", k, 1) for k in range(45)]
    t = tables(spark, msgs(spark, 1), chain, [(f"s{k}", f"s{k + 1}") for k in range(44)], [("s0", "a-1")])
    cover = {r.id: r.n_messages for r in dag.coverage(t["summaries"], t["summary_parents"], t["summary_messages"], t["messages"]).collect()}
    assert cover == {f"s{k}": 1 for k in range(45)}
    shared = tables(spark, msgs(spark, 2), [("l", 0, 1), ("p", 1, 1), ("q", 1, 1), ("r", 2, 1)], [("l", "p"), ("l", "q"), ("p", "r"), ("q", "r")], [("l", "a-1"), ("l", "a-2")])
    cover = {r.id: r.n_messages for r in dag.coverage(shared["summaries"], shared["summary_parents"], shared["summary_messages"], shared["messages"]).collect()}
    assert cover == {"l": 2, "p": 2, "q": 2, "r": 2}


def test_errors(tmp_path):
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise EngineError("busy", "DB_BUSY", True)

    with pytest.raises(EngineError):
        errors.retried(fails, 4, 1, 5, sleep=waits.append)
    assert waits == [1, 2, 4, 5] and len(calls) == 5
    with pytest.raises(EngineError):
        errors.retried(fails, 4, 1, 5, lambda e: not isinstance(e, EngineError), waits.append)
    assert len(calls) == 6 and errors.wrapped(fails, "instead", "step") == "instead" and errors.wrapped(lambda: 3, 4, "step") == 3
    log = errors.ErrorLog(str(tmp_path / "a" / "errors.log"))
    log.write(EngineError("x", "DB_X"), "stage")
    log.write(ValueError("y"), "stage")
    lines = (tmp_path / "a" / "errors.log").read_text().splitlines()
    assert lines[0].endswith("[DB_X] stage: x") and lines[1].endswith("[UNKNOWN] stage: y")
    (tmp_path / "a" / "errors.log").write_text("z" * (errors.MOST_LOG + 1))
    log.write(ValueError("new"), "stage")
    assert len((tmp_path / "a" / "errors.log").read_text().splitlines()) == 1
    assert errors.action_after(EngineError("x", "DB_X", True)) == "passthrough" and errors.action_after(EngineError("x", "NET", True)) == "retry"
    assert errors.action_after(ValueError(), ["a"]) == "partial" and errors.action_after(ValueError()) == "passthrough"


def test_token_counters(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    counter = tokens.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", None, "hello world", "Grüße 漢字 " * 40]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(tokens.count_tokens("t", counter).alias("n")).collect()]
    assert got == [counter.count(t) if t else 0 for t in texts] and got[:2] == [0, 0] and got[2] == 2
    assert [r.n for r in df.select(tokens.count_tokens("t", tokens.Estimate()).alias("n")).collect()] == [r.n for r in df.select(T.estimate_tokens("t").alias("n")).collect()]
    for r, t in zip(df.select(tokens.split_by_counter("t", 30, counter).alias("s")).collect(), texts, strict=True):
        assert r.s.head + r.s.tail == (t or "") and counter.count(r.s.head) <= 30


def test_tools_and_sessions(spark):
    t = tables(spark, msgs(spark, 3, texts=["find me here", "nothing", "find more"]).unionByName(msgs(spark, 1, "b", ["find other"])), [("s", 0, 5)], [], [("s", "a-1"), ("s", "a-2")])
    known = tools.registered()
    text = known["search"].call(t, "a", "find")
    assert text.count("[Message #") == 2 and "[Message #1 | user | 2024-01-01 10:00]\n<b>find</b> me here" in text and "other" not in text
    assert known["search"].call(t, "a", " ").startswith("Error") and known["search"].call(t, "a", "absent") == "No results found for 'absent'. Try different search terms."
    assert known["search"].call(t, "a", "content") == "[Summary depth=0 | covers #1-2 | 2024-01-01 10:00]\n<b>content</b> s"
    assert known["search"].call(t, "a", "content", "messages").startswith("No results")
    assert known["expand"].call(t, "a", "messages:2-2").endswith("nothing") and "Messages: 3" in known["describe"].call(t, "a")
    assert [r.id for r in ingest.lookup(t["messages"], "a", ["a-2", "b-1"]).collect()] == ["a-2"]
    empty = spark.createDataFrame([], SCHEMAS["conversations"])
    new = ingest.new_session(empty, "n")
    assert [r.id for r in new.collect()] == ["n"] and ingest.new_session(new, "n").count() == 0
    info = spark.createDataFrame([("a", 2, '{"role":"assistant","providerID":"p2","modelID":"m2"}'), ("a", 1, '{"role":"user","model":{"providerID":"p1","modelID":"m1"}}'), ("b", 1, '{"role":"user"}')], "conversation_id string, arrival int, info string")
    assert sorted(map(tuple, ingest.model_ids(info).collect())) == [("a", "p1", "m1"), ("b", "threadloom", "threadloom")]
    assert spark.range(1).select(T.iso_from_millis(F.lit(1704103200123)).alias("t")).first().t == "2024-01-01T10:00:00.123Z"


def test_snippets_mark_whole_phrases(spark):
    df = spark.createDataFrame([("the old red fox saw the red-hot fox and a red fox",)], "t string")
    mark = lambda q: df.select(search.snippet("t", q, 20).alias("s")).first().s
    assert mark('"red fox"') == "the old <b>red</b> <b>fox</b> saw the red-hot fox and a <b>red</b> <b>fox</b>"
    assert mark('"red hot" OR sa*') == "the old red fox <b>saw</b> the <b>red-hot</b> fox and a red fox"


def test_a_check_that_raises_is_a_warning(spark):
    t = tables(spark, msgs(spark, 2), [("s", 0, 5)])
    got = {r.name: r.status for r in integrity.run_checks(t | {"summary_parents": t["summary_parents"].drop("parent_id")}, EngineConfig()).collect()}
    assert got["dag-acyclicity"] == "warn" and got["message-ordering"] == "pass"
