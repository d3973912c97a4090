"""Url verdicts, whitening and the Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from corpusmill.llm import merkle, url_rules, whitening

# Urls and the host graph


def plain_verdicts(rows, rules=url_rules.RULES, damping=url_rules.DAMPING, steps=url_rules.STEPS):
    """(page_id, url, html) -> page_id, host, path, rule, verdict."""
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    pages, links, count = [], Counter(), defaultdict(Counter)
    for page, url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(lower)
        fit = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        rule = max(fit, key=lambda r: (len(r[1] + r[2]), r)) if fit else None
        pages.append((page, host, path, rule))
        if host:
            count[host]["all"] += 1
            count[host][rule[0] if rule else ""] += 1
            for to in {x.translate(lower) for x in re.findall(url_rules.LINK, html or "")} - {"", host}:
                links[host, to] += 1
    hosts = sorted({*count, *(b for _, b in links)})
    at = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in links.items():
        w[at[a], at[b]] = n
    scores = {}
    for kind, m in (("allow", w), ("block", w.T)):
        seed = np.array([count[h][kind] / count[h]["all"] if count[h]["all"] and count[h][kind] / count[h]["all"] > 0.5 else 0.0 for h in hosts])
        step = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        total, now = seed.copy(), seed
        for _ in range(steps):
            now = damping * now @ step
            total += now
        scores[kind] = total / total.sum() if total.sum() else total
    bad = {h for i, h in enumerate(hosts) if round(scores["block"][i] * len(hosts), 9) >= 1 and round(scores["block"][i] - scores["allow"][i], 9) > 0}
    return [(page, host, path, rule[1] + rule[2] if rule else None, rule[0] if rule else "block" if host in bad else "allow") for page, host, path, rule in pages]


def verdicts(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in extra.split():
        df = df.selectExpr("*", f"'x' AS {c}")
    return [tuple(r) for r in url_rules.judge(df).collect()]


def key(row):
    return tuple((v is not None, v) for v in row)


def test_urls_are_cut_and_ruled(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "https://example.net": ("example.net", "", None, "allow"), "x://y.net/fr": ("y.net", "/fr", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "http://www.example.com/de/1": ("www.example.com", "/de/1", "example.com/de/", "block"), "http://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "http://h?a://b": ("h", "", None, "allow"), "http://h:80#/x": ("h:80", "", None, "allow"), "mailto:a@b.net": ("", "", None, "allow"), "http:///net/": ("", "/net/", None, "allow"), "http://É.org/FR/": ("É.org", "/FR/", None, "allow"), "": ("", "", None, "allow"),
    }
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(None, None, None), (None, None, None)]
    got = sorted(verdicts(spark, rows, "host verdict rule ruling src _blocked"), key=key)
    assert got == sorted([(i, *v) for i, v in enumerate(urls.values())] + [(None, "", "", None, "allow")] * 2, key=key)


def test_trust_and_distrust_follow_links(spark):
    def links(*hosts):
        return "".join(f"<a class='k' HREF=\"//{h.upper()}/p\">x</a><a href='http://{h}'>y</a>" for h in hosts)

    rows = [(0, "http://bad.net/x", links("a.com")), (1, "http://farm.com/en", links("bad.net")), (2, "http://farm2.com/en", links("farm.com", "bad.net")), (3, "http://good.org/fr/1", links("fine.com")), (4, "http://fine.com/", None), (5, "http://lone.com/", "")]
    got = {r[0]: r[4] for r in verdicts(spark, rows)}
    assert got[1] == got[2] == "block" and got[4] == got[5] == "allow"
    assert sorted(verdicts(spark, rows)) == sorted(plain_verdicts(rows))


@pytest.mark.parametrize("few", [10_000, 0])
def test_random_graphs_match_power_series(spark, monkeypatch, few):
    monkeypatch.setattr(url_rules, "FEW_HOSTS", few)
    rng = random.Random(3)
    hosts = [f"h{i}.{rng.choice(['com', 'net', 'org', 'example.com', 'example.net'])}" for i in range(25)]
    rows = []
    for i in range(200):
        h = rng.choice(hosts[: 1 + i % 25])
        html = "".join(f'<p><a rel=x href = "{rng.choice(["https:", "", "http:"])}//{rng.choice(hosts)}/q">' for _ in range(rng.randrange(4))) + '<a href="/own">'
        rows.append((i % 150, f"http://{h}/{rng.choice(['en', 'de', 'fr'])}/{i}", html if i % 9 else None))
    want = plain_verdicts(rows)
    assert sorted(verdicts(spark, rows), key=key) == sorted(want, key=key)
    assert {v for *_, rule, v in want if rule is None} == {"allow", "block"}


def test_mass_is_kept_and_steps_end(spark):
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("b", 0.0, 1.0)], "host string, trust double, distrust double")
    edges = spark.createDataFrame([("a", "c", 3), ("a", "b", 1), ("c", "d", 1)], "src string, dst string, weight long")
    got = {r.host: (r.trust, r.distrust) for r in url_rules.propagate(seeds, edges).collect()}
    assert math.isclose(sum(t for t, _ in got.values()), 1) and math.isclose(sum(d for _, d in got.values()), 1)
    assert got["c"][0] > got["b"][0] > 0 and got["a"][1] > 0 and got["d"][1] == 0


def test_no_pages(spark):
    assert verdicts(spark, []) == []


# Whitening


def plain_integers(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 2**30 for c in v)]
    sizes = Counter(len(v) for _, v in kept)
    width = max(sizes, key=lambda k: (sizes[k], k)) if sizes else 0
    return [(i, [math.floor(1024 * Fraction(c)) + 100000 for c in v]) for i, v in kept if len(v) == width]


def whitened(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS component", "2 AS n", "3 AS x", "4 AS width")
    return whitening.whiten(df).collect()


def check_whitened(got, rows, most=8):
    xs = plain_integers(rows)
    n, width = len(xs), len(xs[0][1])
    sums = [sum(x[j] for _, x in xs) for j in range(width)]
    assert Counter(r.vec_id for r in got) == Counter({i: k * min(most, width) for i, k in Counter(i for i, _ in xs).items()})
    exact = Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums))) for i, x in xs)
    assert Counter((r.vec_id, int(r.deviation)) for r in got if r.component == 1) == exact
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for _, x in xs])
    v = y.T @ y / n
    e = np.linalg.eigvalsh(v)[::-1]
    assert all(r.n == n for r in got)
    for k in range(1, min(most, width) + 1):
        assert got and all(math.isclose(r.explained, e[k - 1] / e.sum(), rel_tol=1e-4, abs_tol=1e-15) for r in got if r.component == k)
    return xs, y, v, e


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [None] * 12), (902, [math.nan] + [0.0] * 11), (903, [math.inf] + [0.0] * 11), (904, [1.0] * 5), (905, [])]
    got = whitened(spark, rows)
    xs, y, v, e = check_whitened(got, rows)
    unique = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id not in (7, None)}
    for k in range(1, 9):
        w = np.array([unique[i, k] for i in range(300) if i != 7])
        own = np.linalg.eigh(v)[1][:, ::-1][:, k - 1]
        want = (y[[i for i in range(300) if i != 7]] @ own) / math.sqrt(e[k - 1])
        assert np.allclose(w, want, atol=1e-8) or np.allclose(w, -want, atol=1e-8)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_is_exact_for_large_entries_and_flat_dimensions(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-(2**29), 2**29), 1.5, -rng.random(), 0.25]) for i in range(50)] + [(99, [2.0**30, 0.0, 0.0, 0.0])]
    got = whitened(spark, rows, "double")
    check_whitened(got, rows)
    assert all((r.whitened is None) == (r.component >= 2) for r in got)  # the third dimension's variance is below rank, next to 10^17
    assert got[0].identity_error < 1e-9


def test_whitening_without_variance_or_rows(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None), (2, [])]) == []
    got = whitened(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert len(got) == 4 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in got)


@pytest.mark.parametrize("size", [1, 1 << 30, 1 << 40])
def test_polarisation_recovers_covariances(size):
    rng = random.Random(size)
    x = [[rng.randrange(-size, size + 1) for _ in range(5)] for _ in range(40)]
    n = len(x)
    rest = [sum(r[j] for r in x) for j in range(5)]
    got = whitening.covariance(n, rest, whitening.pair_squares(np.array(x)))
    for i in range(5):
        for j in range(5):
            want = sum(Fraction(n * r[i] - rest[i], n) * Fraction(n * r[j] - rest[j], n) for r in x) / n
            assert math.isclose(got[i, j], want, rel_tol=1e-15, abs_tol=1e-12)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_fold(nodes, arity):
    """The root of a list of digests, and each one's steps as (left, right)."""
    steps, levels = [[] for _ in nodes], [list(nodes)]
    while len(levels[-1]) > 1:
        now = levels[-1]
        for i in range(len(nodes)):
            k = i // arity ** (len(levels) - 1)
            a = k // arity * arity
            steps[i].append(("".join(now[a:k]), "".join(now[k + 1 : a + arity])))
        levels.append([sha(*now[a : a + arity]) for a in range(0, len(now), arity)])
    return levels[-1][0], steps


def plain_manifest(rows, arity=2):
    """rows (doc_id, text, lang, source, n_chars) -> doc_id, leaf, subroot, root, proof, folded, verified."""

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0 and n is not None
        leaf, changed = (sha(*map(field, (doc, source, lang, m, text))) for m in (n, n + 1 if hit else n))
        groups[lang].append(((doc is not None, doc or 0, leaf), doc, leaf, changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    folded = {g: plain_fold([r[2] for r in sorted(groups[g])], arity) for g in order}
    if not order:
        return []
    root, tops = plain_fold([folded[g][0] for g in order], arity)
    out = []
    for g, up in zip(order, tops):
        for (_, doc, leaf, changed), steps in zip(sorted(groups[g]), folded[g][1]):
            node = changed
            for left, right in steps + up:
                node = sha(left, node, right)
            out.append((doc, leaf, folded[g][0], root, sha(*[x for s in steps + up for x in s]), node, node == root))
    return out


def manifest_rows(spark, rows, arity=2, levels=10):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS grp", "2 AS pos", "'y' AS leaf", "3 AS n", "4 AS steps")
    done = merkle.manifest(df, arity=arity, levels=levels)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    node = merkle.folded(F.col("tampered"), F.col("steps"))
    return sorted((tuple(r) for r in done.select("doc_id", "leaf", "subroot", "root", merkle.digest(siblings), node, node == F.col("root")).collect()), key=key)


def odd_rows():
    rows = [(i, f"text {i} ü", "en", "s", i) for i in range(37)] + [(i, None, "de", None, None) for i in range(5)] + [(3, "a", "fr", "s", 1), (None, "b", None, "s", 2), (None, None, None, None, None), (-7, "", "", "", 0)]
    rows += [(9, "t" * 300_000, "es", "s", 2**62), (9, "u", "es", "s", 3), (9, "u", "es", "s", 3), (8, "v", "es", "s", 2**63 - 1)]
    return rows + [(i, "q", f"lang{i}", "s", 5) for i in range(6)] + [(70 + i, "q", "eñ", "s", 5) for i in range(3)]


@pytest.mark.parametrize(("arity", "levels"), [(2, 10), (2, 2), (3, 2)])
def test_manifest_matches_plain_tree(spark, arity, levels):
    rows = odd_rows()
    random.Random(5).shuffle(rows)
    assert manifest_rows(spark, rows, arity, levels) == sorted(plain_manifest(rows, arity), key=key)


def test_a_single_leaf_is_its_root_and_no_leaves_give_no_rows(spark):
    one = [(1, "x", "en", "s", 1)]
    got = manifest_rows(spark, one)
    assert got == plain_manifest(one) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    assert manifest_rows(spark, []) == []


def test_tampering_is_found_where_it_was_done(spark):
    rows = [(i, "x", "en", "s", None if i % 5 == 0 else i) for i in range(64)]
    bad = {r[0] for r in manifest_rows(spark, rows) if not r[6]}
    assert bad == {i for i in range(64) if zlib.crc32(str(i).encode()) % 7 == 0 and i % 5} and bad
