import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.llm import chat, mixing, url_filter
from gapline.llm.queries import CHAT_SCHEMAS, ORACLE_SQL, QUERIES, URL_RULES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", ["op6_mixing", "op8_tool_call_linking"])
def test_parity(name, spark, tiny):
    compare(connect(tiny), QUERIES[name](spark, tiny), ORACLE_SQL[name])


def brute_targets(sizes, weights, limit):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > limit * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = float(limit * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_targets_against_resharing(spark):
    sizes = {"a": 3, "b": 500, "é": 20, "Z": 4, "z": 900, None: 1, "empty": 0, "y": 60}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = brute_targets(sizes, (5, 2, 1), 3)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix_corner_cases(spark, clash):
    rows = [(1, "a b  c", "s"), (1, "a b  c", "s"), (None, "x", None), (2, None, "s"), (3, "", "t"), (4, "w " * 200_000, "u"), (5, "a\u00a0b\x1c c\u3000d", "u")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string, source string"), ("size", "target", "taken", "copies", "rank"))
    got = mixing.mix(df).collect()
    assert len(got) == 7
    assert {r.doc_id: r.size for r in got} == {1: 3, None: 1, 2: 0, 3: 0, 4: 200_000, 5: 2}
    assert all(r.taken == r.size * r.copies and r.copies <= 3 for r in got)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.taken) for r in got) == sorted((str(r.doc_id), r.taken) for r in again)
    assert mixing.mix(df.limit(0)).collect() == []
    out = mixing.emit(mixing.mix(df), ["doc_id", "text", "source"])
    assert out.columns == ["doc_id", "text", "source"]
    assert out.count() == sum(r.copies for r in got)


def test_null_ids_draw_by_their_texts(spark):
    rows = [(None, f"a{i} b c d", "one") for i in range(400)] + [(i, "w " * 20, "two") for i in range(60)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("source = 'one'")
    r = out.agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.countDistinct("copies").alias("n")).first()
    assert r.n == 2
    assert abs(r.taken / r.target - 1) < 0.1


def test_taken_words_come_near_their_targets(spark, tiny):
    rows = QUERIES["op6_mixing"](spark, tiny.replace("sf0.001", "sf0.1"))
    by = rows.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken / r.target - 1) < 0.2 for r in by)


def brute_judge(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(t), t, v) for v, t in URL_RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])), default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_rules_against_brute_force(spark, tiny, clash):
    urls = ["http://Example.COM/en/x", "http://www.example.com/en/", "http://a.www.example.com/en/q?x", "https://net/es/", "ftp://b.net/fr/#x", "http://b.net/fr", "http://evilexample.com/en/", "no scheme", None, "", "http://com", "http://x.com?y/en/", "a://b://net/es/", "http://É.net/es/é", "http://b.org/" + "p" * 100_000, "http://b.org/"]
    urls += [r.url for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()]
    none = spark.createDataFrame([], "items array<string>, key string, confidence double, support double")
    df = clash(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), ("host", "path", "rule", "verdict", "key", "items", "confidence"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, URL_RULES, none).collect()}
    assert got == {i: brute_judge(u) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), URL_RULES, none).collect() == []


def test_mined_rules_block(spark):
    good = [(f"https://news{i % 5}.org/en/{i}.html", False) for i in range(60)]
    bad = [(f"http://pills{i % 4}.org/win/{i}?ref=x", True) for i in range(30)] + [(f"http://news{i % 5}.org/win/{i}", False) for i in range(20)]
    rules = url_filter.mine(spark.createDataFrame([*good, *bad, (None, True), ("http://x.org/", None)], "url string, bad boolean"), 0.05, 0.8)
    assert rules.count() > 0
    probe = spark.createDataFrame([(1, "http://pills1.org/win/777?ref=y"), (2, "http://news1.org/win/5"), (3, "https://news2.org/en/9.html"), (3, "https://news2.org/en/9.html")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge(probe, [], rules).collect()) == [(1, "block"), (2, "allow"), (3, "allow"), (3, "allow")]
    # the index finds what a scan of all rules finds
    have = {r.url: set(r.t) for r in probe.select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    scan = {u for u, t in have.items() for r in rules.collect() if set(r["items"]) <= t}
    assert {r.url for r in url_filter.match(probe, rules).collect()} == scan
    assert url_filter.mine(spark.createDataFrame([], "url string, bad boolean")).collect() == []


def wilson(good, n, z):
    p = good / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_the_whole_judgement_against_brute_force(spark):
    """Rules by counting every set of tokens that labelled URLs have, then verdicts by trying every rule on every URL."""
    rng = random.Random(4)
    hosts, paths, ends = ["a.x.org", "b.x.org", "shop.y.net", "z.com"], ["/win/{}", "/en/{}", "/en/win-{}/more", "/img/{}.png"], ["", "?ref=1", "?page=2&ref=3", "#top"]
    url = lambda: f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths).format(rng.randrange(99))}{rng.choice(ends)}"
    odds = lambda u: 0.9 if "win" in u and "ref" in u else 0.8 if "shop" in u and "img" in u else 0.1
    labelled = [(u, rng.random() < odds(u)) for u in (url() for _ in range(500))]
    labelled += [("https://hot.q.org/" + "/".join(f"part-{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)), True)] * 250  # a third of all, long
    pages = [(i, url()) for i in range(120)] + [(500, labelled[-1][0]), (501, "https://hot.q.org/"), (502, None), (503, "http://example.com/en/win/1?ref=2")]
    probe = spark.createDataFrame(pages, "page_id long, url string")
    have = {r.url: frozenset(r.t) for r in spark.createDataFrame([(u,) for u, _ in labelled] + [(u,) for _, u in pages], "url string").distinct().select("url", url_filter.tokens(F.col("url")).alias("t")).collect()}
    support, confidence, least, z = 0.02, 0.6, 20, 2.33
    n, bad = len(labelled), sum(b for _, b in labelled)
    need = max(math.ceil(support * n), least)
    counts = {}
    for u, b in labelled:
        if "hot" in u:
            continue  # its 130 tokens have too many sets to count; those it has alone are one item, counted below
        for k in range(1, len(have[u]) + 1):
            for some in itertools.combinations(sorted(have[u]), k):
                c = counts.setdefault(frozenset(some), [0, 0])
                c[0] += 1
                c[1] += b
    hot = have[labelled[-1][0]]
    for some, c in counts.items():
        if some <= hot:
            c[0] += 250
            c[1] += 250
    rules = {s: c[1] / c[0] for s, c in counts.items() if c[1] >= need and c[1] / c[0] > bad / n and wilson(c[1], c[0], z) >= confidence}
    rules |= {frozenset([t]): 1.0 for t in hot if frozenset([t]) not in counts}
    assert any(len(s) > 1 for s in rules)
    mined = url_filter.mine(spark.createDataFrame(labelled, "url string, bad boolean"), support, confidence, least, z)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.confidence and round(r.confidence, 9)) for r in url_filter.judge(probe, URL_RULES, mined).collect()}
    for i, u in pages:
        host, path, rule, verdict = brute_judge(u)
        best = max((c for s, c in rules.items() if u and s <= have[u]), default=None) if rule is None else None
        assert got[i] == (host, path, rule, "block" if best else verdict, best and round(best, 9)), u
    # none of the rules says what a shorter one says, and each set counts what it claims
    for r in mined.collect():
        s = frozenset(x.split(url_filter.BAR)[0] for x in r["items"])
        assert abs(r.confidence - rules[s]) < 1e-9
        assert not any(o < s and rules[o] >= rules[s] for o in rules)


def test_noise_gives_no_rules(spark):
    """Labels that do not depend on the URL, at any number of rows."""
    rng = random.Random(8)
    for n in (40, 400, 4000):
        rows = [(f"https://h{rng.randrange(30)}.s{rng.randrange(9)}.org/{rng.choice('abc')}/{i}", rng.random() < 0.25) for i in range(n)]
        assert url_filter.mine(spark.createDataFrame(rows, "url string, bad boolean")).collect() == []


CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"
SCHEMAS = {"add": {"required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "number", "minimum": 0}, "note": {"type": "string", "minLength": 2}}, "additionalProperties": False}}


def test_arguments(spark):
    cases = [('{"b":1.5,"a":2}', True), ('{"a":2}', False), ('{"a":"2","b":1}', False), ('{"a":1,"b":-1}', False), ('{"a":1,"b":1,"c":1}', False), ('{"a":1,"b":1,"note":"x"}', False), ('{"a":1,"b":1,"note":"xy"}', True), ("{broken", False), (None, False), ("[1]", False), ('{"a":null,"b":1}', False)]
    calls = spark.createDataFrame([(1, i, f"c{i}", "add", a) for i, (a, _) in enumerate(cases)] + [(1, 99, "u", "unknown", "{}")], CALLS)
    got = {r.call_id: r for r in chat.link(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    assert [got[f"c{i}"].valid for i in range(len(cases) - 1)] == [ok for _, ok in cases[:-1]]
    assert got["u"].valid is False
    assert got["c0"].record == '{"arguments":{"a":2,"b":1.5},"id":"c0","name":"add","result":null}'
    assert json.loads(got["c7"].record)["arguments"] is None


def test_linking_and_order(spark, clash):
    calls = clash(spark.createDataFrame([(1, 5, "x", "add", "{}"), (1, 7, "x", "add", "{}"), (1, 1, "y", "add", "{}"), (2, 0, None, "add", "{}"), (3, 0, "z", "add", "{}")], CALLS), ("status", "valid", "record", "x", "id"))
    results = spark.createDataFrame([(1, 2, "x", "early"), (1, 6, "y", "late"), (9, 0, "w", "stray"), (9, 0, None, None), (1, 6, "y", "later")], RESULTS)
    got = sorted(((str(r.call_id), r.status, r.call_turn, r.result_turn, r.result_place, r.result_level) for r in chat.link(calls, results, SCHEMAS).collect()), key=str)
    assert got == sorted([("x", "linked", 5, 2, 5, 1), ("y", "linked", 1, 6, 6, 0), ("z", "unanswered", 0, None, None, None), ("None", "unanswered", 0, None, None, None), ("None", "orphan", None, 0, None, None), ("w", "orphan", None, 0, 0, 0), ("x", "repeated_call", 7, None, None, None), ("y", "repeated_result", None, 6, None, None)], key=str)


def test_turns_with_null_keys_stay_apart(spark, tmp_path):
    """No id is made of half a key: every such turn keeps its own row."""
    rows = [(None, 3, "user", "a"), (None, 3, "user", "b"), (None, 4, "assistant", "c"), (5, None, "user", "d"), (None, 5, "user", "e"), (5, None, "assistant", "f"), (7, 0, "user", "g"), (7, 1, "assistant", "h")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op8_tool_call_linking"](spark, str(tmp_path)).collect()
    assert sorted((str(r.call_id), r.status) for r in got) == sorted([("None", "unanswered")] * 4 + [("None", "orphan")] * 2 + [("call_0", "linked")])


def test_ids_count_inside_their_conversation(spark):
    calls = spark.createDataFrame([(1, 0, "call_1", "add", "{}"), (2, 0, "call_1", "add", "{}"), (None, 0, "call_1", "add", "{}"), (3, 0, "call_1", "add", "n" * 300_000)], CALLS)
    results = spark.createDataFrame([(1, 1, "call_1", "one"), (2, 1, "call_1", "two"), (None, 1, "call_1", "none"), (2, 2, "call_1", "two"), (2, 1, "call_1", "two")], RESULTS)
    got = chat.link(calls, results, SCHEMAS).collect()
    assert sorted((str(r.conv_id), r.status, json.loads(r.record)["result"]) for r in got) == sorted(
        [("1", "linked", "one"), ("2", "linked", "two"), ("2", "repeated_result", "two"), ("2", "repeated_result", "two"), ("None", "unanswered", None), ("None", "orphan", "none"), ("3", "unanswered", None)], key=str
    )


def test_the_query_orders_and_rejects(spark, tiny):
    """On the test tables the order has depth, and arguments of both tools fail and hold."""
    rows = QUERIES["op8_tool_call_linking"](spark, tiny.replace("sf0.001", "sf0.01")).collect()
    assert max(r.call_level or 0 for r in rows) > 1
    assert any(r.call_place > r.call_turn for r in rows if r.call_place is not None)
    assert {(json.loads(r.record)["name"], r.valid) for r in rows if r.status != "orphan"} >= {("search", True), ("search", False), ("reply", True)}


def test_the_joins_hash(spark, tiny):
    plan = QUERIES["op8_tool_call_linking"](spark, tiny)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_places_follow_dependencies(spark):
    nodes = spark.createDataFrame([("a", 3), ("b", 1), ("c", 1), ("d", 9), ("p", 1), ("q", 1)], "id string, turn long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "p"), ("none", "a")], "before string, after string")
    got = {r.id: (r.turn, r.level) for r in chat.places(nodes, edges, 6).collect()}
    assert got["a"] < got["b"] < got["c"] < got["d"]
    assert got["d"] == (9, 0)
    assert got["p"][1] is None or got["q"][1] is None


def test_empty_chat(spark):
    assert chat.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), CHAT_SCHEMAS).collect() == []
