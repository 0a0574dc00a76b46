import math
import re
from collections import Counter, defaultdict

import pytest

from tapeloom.llm.url_filter import END, RULES, START, best_threshold, fit, judge, op2_url_model, with_rules

UP = {ord(c): chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "page_id bigint, url string, html string, host string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UP), re.match(r"[^?#]*", rest[len(host):])[0]


def rule_of(host, path, rules=RULES):
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = [None, "", "nope", "http://", "https://A.Example.COM/en/7x?q#f", "https://b.example.com/en/6", "http://example.net/de/8", "http://example.net/de/9", "ftp://x.org?y=/es/",
        "http://x.org/es/1", "http://xcom/en/", "http://a.com:80/en/", "x://y://z/q", "http://é.net/de/ü#", "http://" + "a" * 3000 + ".com/fr/"]


def rows_of(n=200):
    made = [(i, u, "h", "clash") for i, u in enumerate(URLS)]
    return made + [(100 + i, f"https://s{i % 7}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'de', 'es', 'fr')[i % 4]}/{i * 37 % 100}", "h", "clash") for i in range(n)]


def brute(rows):
    judged = [(i, u, *parts(u), *rule_of(*parts(u))) for i, u, *_ in rows]
    return judged


def test_rules_match_brute_force(spark):
    made = rows_of()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["by_rule"]) for r in with_rules(spark.createDataFrame(made, SCHEMA), RULES).collect()}
    assert got == {i: rest for i, _, *rest in [(x[0], x[1], *x[2:]) for x in brute(made)] for rest in [tuple(rest)]}


def test_model_matches_brute_force(spark):
    made = rows_of()
    judged = with_rules(spark.createDataFrame(made, SCHEMA), RULES)
    model = fit(judged, per_class=10_000)
    known = [(r["by_rule"], r["url"], r["h"]) for r in judged.filter("by_rule is not null").selectExpr("by_rule", "url", "xxhash64(url) h").collect()]
    train, held = defaultdict(list), defaultdict(list)
    for v in ("allow", "block"):
        for k, (_, u, _) in enumerate(sorted((x for x in known if x[0] == v), key=lambda x: (x[2], x[1])), 1):
            (held if k % 5 == 0 else train)[v].append(u)
    counts = {v: defaultdict(Counter) for v in train}
    for v, urls in train.items():
        for u in urls:
            t = START + u + END
            for i in range(1, len(t)):
                for k in range(min(5, i) + 1):
                    counts[v][t[i - k : i]][t[i]] += 1
    size = len({t for v in counts.values() for c in v.values() for t in c}) + 1

    def p(v, context, char):
        out = 1 / size
        for k in range(min(5, len(context)) + 1):
            c = counts[v].get(context[len(context) - k :])
            if not c:
                break
            out = (c[char] + len(c) * out) / (sum(c.values()) + len(c))
        return out

    def difference(u):
        t = START + u + END
        return sum(math.log(p("allow", t[max(0, i - 5) : i], t[i])) - math.log(p("block", t[max(0, i - 5) : i], t[i])) for i in range(1, len(t))) / (len(t) - 1)

    cut = best_threshold([difference(u) for u in held["allow"]], [difference(u) for u in held["block"]])
    for r in judge(judged, model).collect():
        u = made[[x[0] for x in made].index(r["page_id"])][1] or ""
        assert r["difference"] == pytest.approx(difference(u), abs=1e-9)
        by_rule = rule_of(*parts(made[[x[0] for x in made].index(r["page_id"])][1]))[1]
        assert r["verdict"] == (by_rule or ("allow" if r["difference"] >= cut else "block"))


def test_one_class_or_none(spark):
    none = with_rules(spark.createDataFrame([(1, "http://x.fr/", "", "")], SCHEMA), RULES)
    assert judge(none, fit(none)).first()["verdict"] == "allow"
    one = with_rules(spark.createDataFrame([(1, "http://x.fr/", "", ""), (2, "http://x.org/es/", "", "")], SCHEMA), RULES)
    assert {r["verdict"] for r in judge(one, fit(one)).collect()} == {"block"}


def test_threshold_separates():
    assert 1 < best_threshold([2.0, 3.0], [0.0, 1.0]) < 2
    assert best_threshold([], [1.0]) == 0.0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert op2_url_model(spark, str(tmp_path)).count() == 0


def test_partitions_do_not_change_the_fit(spark):
    """More rows than ``per_class``, repeated rows, null ids, in 1 and in 500 partitions: one model, that of the least hashed rows."""
    made = [(None if i % 50 == 0 else i, u, "h", "clash") for i, u, *_ in rows_of(900)]
    made += made[:120]

    def fitted(parts, per_class):
        m = fit(with_rules(spark.createDataFrame(made, SCHEMA).repartition(parts), RULES), per_class=per_class)
        return m.threshold, [m.difference(u or "") for u in URLS]

    few = fitted(1, 60)
    assert few == fitted(500, 60) and few != fitted(1, 10_000) and fitted(1, 10_000) == fitted(500, 10_000)
    judged = with_rules(spark.createDataFrame(made, SCHEMA), RULES)
    rows = judge(judged, fit(judged, per_class=60)).collect()
    assert len(rows) == len(made) and sum(r["page_id"] is None for r in rows) == sum(x[0] is None for x in made)


def test_all_ruled_urls_are_learned_from(spark):
    """More than 5,000 URLs a class, and ruled URLs of more than 500 characters: the fit is that of bounds which nothing reaches."""
    made = [(i, f"https://s{i % 7}.example.{('com', 'org')[i % 2]}/{('en', 'es')[i % 2]}/{i:x}" + "long" * (200 if i % 999 == 0 else 0), "h", "c") for i in range(14_000)]
    made += [(i, f"http://a{i % 11}.net/de/{i * 7919 % 10007}", "h", "c") for i in range(6_000)]
    judged = with_rules(spark.createDataFrame(made, SCHEMA), RULES)
    whole, bounded = fit(judged), fit(judged, per_class=10**9, max_chars=10**9)
    urls = ["http://x.fr/longlong/1a", "https://s1.example.com/de/7", ""]
    assert whole.threshold == bounded.threshold and [whole.difference(u) for u in urls] == [bounded.difference(u) for u in urls]
    cut = fit(judged, per_class=5_000, max_chars=500)
    assert [whole.difference(u) for u in urls] != [cut.difference(u) for u in urls]
    # Four of five rows are counted, with one end each.
    ruled = judged.groupBy("by_rule").count().collect()
    assert whole.grams.filter(f"gram = '{END}'").first().asDict() == {"gram": END, **{r["by_rule"]: r["count"] - r["count"] // 5 for r in ruled}}


def test_shuffled_scores_equal_broadcast_ones(spark, monkeypatch):
    """Frequent grams dealt over tasks, none broadcast; letters of two UTF-16 units, line ends, marks of start and end, one URL of a million characters."""
    from tapeloom.llm import url_filter

    odd = ["http://x.org/es/\U0001f600\U00010400/é\n\r", f"http://x.net/de/{START}{END}{START}b", "http://a.fr/" + "ab\U0001f600" * 350_000, "ü", "\U0001f600"]
    made = rows_of(120) + [(1000 + i, u, "h", "c") for i, u in enumerate(odd)]
    judged = with_rules(spark.createDataFrame(made, SCHEMA), RULES)

    def scored():
        model = fit(judged)
        return model, {r["page_id"]: (r["difference"], r["verdict"]) for r in judge(judged, model).collect()}

    model, small = scored()
    monkeypatch.setattr(url_filter, "broadcast_if_small", lambda df: df)
    assert scored()[1] == small and len(small) == len(made)
    for i, u, *_ in made[:15] + made[-len(odd):]:
        assert small[i][0] == pytest.approx(model.difference(u or ""), abs=1e-9)


def test_cut_of_a_table_is_that_of_lists(spark):
    from tapeloom.llm.url_filter import cut_of

    for seed, share in ((1, 0.3), (2, 0.9), (3, 0.5)):
        near = [(seed * 7919 * i % 101 / 10 - 5, i % 10 < share * 10) for i in range(60)]
        near = [(d + 2 * a, a) for d, a in near]
        rows = defaultdict(lambda: [0, 0])
        for d, a in near:
            rows[d][0 if a else 1] += 1
        marked = spark.createDataFrame([(d, *n) for d, n in rows.items()], "difference double, allow bigint, block bigint").repartition(5)
        assert cut_of(marked) == best_threshold([d for d, a in near if a], [d for d, a in near if not a])
    # No cut is better than allowing all.
    marked = spark.createDataFrame([(0.0, 1, 0), (1.0, 0, 1)], "difference double, allow bigint, block bigint")
    assert cut_of(marked) == best_threshold([0.0], [1.0]) == 0.0
