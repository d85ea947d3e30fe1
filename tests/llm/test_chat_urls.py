import datetime

import pytest

from tests.oracle import same
from threadloom.llm import chat, queries, urls


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert same(spark, queries.queries()[name], queries.oracle_sql()[name]) > 0


def brute_chats(rows):
    logs = {}
    for conv, turn, role, text in set(rows):
        logs.setdefault(conv, []).append(((turn is not None, turn or 0), (role or "").strip() or "user", text or ""))
    logs = {c: [x[1:] for x in sorted(t)] for c, t in logs.items()}
    out = {}
    for c, t in logs.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in logs.values()):
            continue
        same_ = [k for k, o in logs.items() if o == t]
        if c == min(same_, key=lambda k: (k is None, k or 0)):
            out[c] = (len(t), len(same_), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def test_snapshots(spark):
    rows = []
    for k in range(1, 6):
        rows += [(k, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(k)]
    rows += [(10 + i, 0, "user", "text 0") for i in range(20)]
    rows += [(50, t, "user", f"long {t}") for t in range(700)] + [(51, t, "user", f"long {t}") for t in range(300)]
    rows += [(60, 0, None, None), (61, 0, "user", ""), (None, 0, "user", "null log"), (70, 5, "user", "a"), (70, 5, "user", "b"), (70, None, "system", "s"), (70, 5, "user", "a")]
    rows += [(80, 0, "user", "text 0"), (80, 1, "user", "branch")]
    rows += [(90, 0, "user", "very long " * 30_000)] * 40 + [(91, 0, "user", "very long " * 30_000), (91, 1, "tool", "end")]
    rows += [(95, None, "user", f"loose {k}") for k in range(300)] + [(96, -3, "user", "below"), (96, 4, "user", "text 0"), (96, 2**40, "user", "far")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(5)
    got = {}
    for r in chat.format_chats(df).orderBy("part").collect():
        n, logs, text = got.get(r.conv_id, (r.n_turns, r.n_logs, ""))
        got[r.conv_id] = (n, logs, text + r.text)
    assert got == brute_chats(rows)


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    caps = spark.createDataFrame([], "capture_id long, url string, fetched date")
    assert urls.filter_captures(caps, spark.createDataFrame([], "entry string, category string, changed date, action string")).count() == 0


def test_intervals_and_ranks(spark):
    d = lambda n: datetime.date(2021, 1, 1) + datetime.timedelta(n)
    changes = [
        ("Bad.example", "spam", d(0), "add"), ("bad.example", "spam", d(0), "add"), ("bad.example", "spam", d(100), "remove"), ("bad.example", "spam", d(200), None), ("bad.example", "spam", d(210), "add"),
        ("bad.example/x", "adult", d(10), "add"), ("sub.bad.example", "ads", d(20), "add"), ("sub.bad.example", "aaa", d(20), "add"), ("tie.example", "z", d(5), "add"), ("tie.example", "z", d(5), "remove"), (None, "spam", d(0), "add"), ("noop.example", "spam", d(0), "remove"),
    ]
    lists = spark.createDataFrame(changes, "entry string, category string, changed date, action string")
    spans = {tuple(r) for r in urls.validity(lists).collect() if r.entry == "bad.example"}
    assert spans == {("bad.example", "spam", d(0), d(100)), ("bad.example", "spam", d(200), datetime.date(9999, 1, 1))}
    caps = [
        (1, "http://bad.example/", d(0), "bad.example"), (2, "http://bad.example/", d(99), "bad.example"), (3, "http://bad.example/", d(100), None), (4, "https://u@BAD.example:80/q", d(500), "bad.example"),
        (5, "http://bad.example/x/y?z", d(50), "bad.example/x"), (6, "http://a.sub.bad.example/", d(50), "sub.bad.example"), (7, "http://notbad.example/", d(50), None), (8, "no host", d(50), None), (9, None, d(50), None), (10, "http://bad.example/", None, None),
        (11, "http://tie.example", d(50), None), (12, "http://noop.example", d(50), None), (2, "http://bad.example/", d(99), "bad.example"), (None, "http://bad.example/", d(1), "bad.example"),
    ]
    df = spark.createDataFrame([(*c[:3], "e") for c in caps], "capture_id long, url string, fetched date, entry string")
    got = sorted([(r.capture_id, r.url, r.fetched, r.entry) for r in urls.filter_captures(df, lists).collect()], key=repr)
    assert got == sorted(caps, key=repr)
    six = urls.filter_captures(df, lists).filter("capture_id = 6").first()
    assert (six.category, six.n_matches, six.decision) == ("aaa", 3, "blocked")


def test_deep_paths_times_and_long_urls(spark):
    t = lambda h: datetime.datetime(2021, 1, 5, h)
    deep = "host.example/a/b/c/d"
    changes = [(deep, "ads", t(3), "add"), (deep, "ads", t(9), "remove"), (deep, "ads", t(12), "add"), ("host.example/a", "spam", t(0), "add"), ("host.example/a/", "none", t(0), "add")]
    lists = spark.createDataFrame(changes, "entry string, category string, changed timestamp, action string")
    long = "http://host.example/a/b/c/d/" + "x/" * 20_000
    caps = [(1, long, t(2), "host.example/a"), (2, long, t(3), deep), (3, long, t(10), "host.example/a"), (4, long, t(13), deep), (5, "http://host.example/a/b/c", t(13), "host.example/a"), (6, "http://host.example/b", t(13), None)]
    df = spark.createDataFrame([(*c[:3], 1) for c in caps], "capture_id long, url string, fetched timestamp, salt int")
    got = sorted((r.capture_id, r.url, r.fetched, r.entry) for r in urls.filter_captures(df, lists).collect())
    assert got == caps
    none = urls.filter_captures(df, lists.limit(0)).collect()
    assert len(none) == 6 and all(r.decision == "allowed" and r.n_matches == 0 for r in none)
    assert urls.filter_captures(df.limit(0), lists).count() == 0
