"""The training-data operators against SQL, brute force and round trips, and on nulls, ties, repeats and empty tables."""

import collections
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from turnstone.llm import best_fit_packing as packing
from turnstone.llm import chat_format, common, exact_dedup, jaccard_join, license_scan, quality_rules, source_mixing, suffix_dedup, toxicity, url_filter
from turnstone.llm import textscan as scan

SPACE = re.compile("[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "a long line of words. " * 20_000
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", None, 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (5, "one two", "en", "b", 7),
    (None, "one  two", "de", "b", 8),
    (6, LONG, "en", "a", len(LONG)),
    (7, "ÀÉ <|endoftext|> \\ </s> 日本 x" * 30, "fr", "c", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blank, repeated and very long texts, and extra columns with clashing names."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *(F.lit(9).alias(c) for c in ("n", "key", "rid", "score", "size", "target", "tree", "length", "component", "v", "row")))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("1 = 0")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute("SET python_enable_replacements = false")
    for t in ("documents", "pages", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    found = c.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


# 1


def test_mix(spark, odd, none):
    assert source_mixing.mix(none).count() == 0
    rows = source_mixing.mix(odd).collect()
    assert len(rows) == len(ROWS)
    assert all(r.m_times <= 3 and (r.m_size or r.m_times == 0) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert abs(sum(rs[0].m_target for rs in by.values()) - sum(r.m_size for r in rows)) < 1e-6
    assert all(rs[0].m_target <= 3 * rs[0].m_source_size + 1e-9 for rs in by.values())
    again = source_mixing.mix(odd.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.m_times)
    assert sorted(map(key, rows), key=repr) == sorted(map(key, again), key=repr)
    assert source_mixing.repeat_taken(odd).columns == odd.columns


# 2


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "https://a.net/x", ""),
            (2, "https://good.org/y", '<LINK href="https://a.net/x" rel="canonical">'),
            (3, "http://other.org/z#f", '<meta http-equiv="refresh" content="0; url=//good.org/y">'),
            (4, "https://w.example.net/en/1", '<link rel=canonical href="https://good.org/y">'),
            (5, None, None),
            (6, "no scheme", "x"),
            (7, "https://free.org/a/b", '<link rel="canonical" href="c">'),
            (8, "https://FREE.org/a/c?q", None),
            (9, "https://x.EXAMPLE.com/de/1?u", None),
            (10, "https://net/", None),
            (11, "https://planet/", None),
            (12, "https://a.org/fr/", None),
        ],
        "page_id long, url string, html string",
    )
    for few in (url_filter.FEW, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, few=few).collect()}
        assert got[1] == ("a.net", "/x", "net/", "block")
        assert [got[i][3] for i in (2, 3)] == ["block", "block"]
        assert got[4] == ("w.example.net", "/en/1", "example.net/en/", "allow")
        assert got[5] == got[6] == ("", "", None, "allow")
        assert got[7][3] == got[8][3] == "allow"
        assert got[9] == ("x.example.com", "/de/1", "example.com/de/", "block")
        assert got[10][2:] == ("net/", "block") and got[11][2:] == (None, "allow") and got[12][2:] == ("org/fr/", "allow")
    assert url_filter.judge(pages.where("1 = 0")).count() == 0


LINKS = [
    # page's url, html, where its links lead (host/path?query), None: nowhere
    ("http://a.org/x/y", '<link rel=canonical href="/z">', ["a.org/z"]),
    ("http://a.org/x/y", '<link rel=canonical href="/go?u=http://bad.net/">', ["a.org/go?u=http://bad.net/"]),
    ("http://a.org/x/y", '<LINK href="../z" REL="alternate Canonical">', ["a.org/z"]),
    ("http://a.org/x/y", "<link rel='canonical' href='./z/../w/.'>", ["a.org/x/w/"]),
    ("http://a.org/x/y?q", '<link rel=canonical href="?p=1&amp;r=2#f">', ["a.org/x/y?p=1&r=2"]),
    ("http://a.org/x/y?q", '<link rel=canonical href="#f">', ["a.org/x/y?q"]),
    ("http://a.org", '<link rel=canonical href="z">', ["a.org/z"]),
    ("https://a.org/x", '<link rel=canonical href="//B.net/z"><link rel="canonical" href="https://c.net">', ["b.net/z", "c.net/"]),
    ("https://a.org/x", '<link rel=canonical href="https://b.org/"><meta http-equiv="Refresh" content="5;URL=\'http://c.org/q?u=1\'">', ["b.org/", "c.org/q?u=1"]),
    ("https://a.org/x", '<meta content="0; /w" http-equiv=refresh><meta http-equiv=refresh content=30>', ["a.org/w"]),
    ("https://a.org/x", '<!-- <link rel=canonical href="/no"> --><script>"<link rel=canonical href=/no>"</script>', []),
    ("https://a.org/x", '<link rel="canonicals" href="/no"><link rel=canonical href="mailto:a@b"><link rel=canonical href="data:text/html,//x.net/">', []),
    ("https://a.org/x", '<base href="https://d.org/e/f"><link rel=canonical href="g">', ["d.org/e/g"]),
    ("https://a.org/x", '<link title="a > b" rel=canonical href="/t"><link rel="stylesheet" href="canonical.css">', ["a.org/t"]),
    ("https://a.org/./b/../c", '<link rel=canonical href="../../../d">', ["a.org/d"]),
    ("https://a.org/x", f'<link rel=canonical data-x="{"y" * 300_000}" href="/long">', ["a.org/long"]),
    ("https://a.org/x", '<link rel=canonical href="">', []),
    (None, '<link rel=canonical href="/z">', []),
    ("no scheme", '<link rel=canonical href="/z">', []),
    ("https://a.org/x", None, []),
]


def test_links(spark):
    df = spark.createDataFrame([(f"{u}{'&' if u and '?' in u else '?'}i={i}" if u and "://" in u else u, h) for i, (u, h, _) in enumerate(LINKS)], "url string, html string")
    got = collections.defaultdict(set)
    for r in url_filter.edges(df).collect():
        got[int(r.a.rpartition("i=")[2])].add(r.b)
    for i, (u, _, to) in enumerate(LINKS):
        # without a query of its own, a bare fragment or query leads back to the page as it is numbered
        want = {f"{t}&i={i}" if t == "a.org/x/y?q" else t for t in to} - ({f"a.org/x/y?q&i={i}"} if u and "q" in u else set())
        assert got[i] == want, LINKS[i]
    assert url_filter.node_of  # and the JVM's nodes are those of the resolver
    paths = ["/", "/a", "/a/..", "/a/../b", "/a/./b/", "/../../c", "/a/b/..", "/.", "/..", "/a//../b", "/.a/..b/...", "/a/.b/../c"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", url_filter.node_of(F.concat(F.lit("http://h"), "p")).alias("node"))
    assert {r.p: r.node for r in df.collect()} == {p: "h" + url_filter.undotted(p) for p in paths}
    for base, ref, want in (("http://a/b/c/d;p?q", r, w) for r, w in (("g", "a/b/c/g"), ("./g", "a/b/c/g"), ("g/", "a/b/c/g/"), ("/g", "a/g"), ("//g", "g/"), ("?y", "a/b/c/d;p?y"), ("g?y", "a/b/c/g?y"), ("", "a/b/c/d;p?q"), (".", "a/b/c/"), ("..", "a/b/"), ("../g", "a/b/g"), ("../..", "a/"), ("../../../g", "a/g"), ("/./g", "a/g"), ("/../g", "a/g"), ("g.", "a/b/c/g."), ("..g", "a/b/c/..g"), ("./../g", "a/b/g"), ("g;x=1/../y", "a/b/c/y"), ("g?y/../x", "a/b/c/g?y/../x"))):
        assert url_filter.resolve(base, ref) == f"http://{want}", ref  # the examples of RFC 3986


def test_aliases(spark):
    """Pages with links at random, against rules and a union-find of the test's own; repeated pages and clashing names."""
    rng = np.random.default_rng(11)
    hosts = ["a.net", "b.org", "www.example.net", "example.com", "de.example.com", "c.io", "d.io"]
    urls = [f"https://{hosts[h]}/{p}/{n}" for h, p, n in zip(rng.integers(0, 7, 300), rng.choice(["en", "fr", "de", "x"], 300), range(300), strict=True)]
    led = {u: [urls[j] for j in rng.integers(0, 300, rng.integers(0, 3))] for u in urls}
    tag = ('<link rel="canonical" href="{}">', "<link href={} rel='x canonical'>", '<meta http-equiv="refresh" content="1; url={}">')
    rows = [(i, u, "".join(tag[rng.integers(0, 3)].format(t) for t in led[u])) for i, u in enumerate(urls)]
    rows += rows[:40] + [(5000 + i, urls[0].upper().replace("HTTPS", "https").replace("/EN", "/en") + "#f", None) for i in range(300)]
    parent = {u: u for u in urls}

    def find(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for u in urls:
        for t in led[u]:
            parent[find(u)] = find(t)

    def rule(url):
        host, _, path = url.partition("://")[2].partition("#")[0].partition("/")
        fits = [(len(r), said == "allow", r, said) for r, said in url_filter.RULES for rh, _, rp in [r.partition("/")] if (host.lower() == rh or host.lower().endswith("." + rh)) and ("/" + path).startswith("/" + rp)]
        return max(fits)[2:] if fits else (None, None)

    bad = {find(u) for u in urls if rule(u)[1] == "block" and led[u] or any(rule(u)[1] == "block" and u in led[v] for v in urls)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in ("host", "node", "a", "b", "v", "component", "alias", "n", "tags")))
    by_id = {i: u for i, u, _ in rows}
    for few in (url_filter.FEW, 0):
        got = url_filter.judge(df, few=few).collect()
        assert len(got) == len(rows)
        for r in got:
            u = by_id[r.page_id]
            said = rule(u)
            assert (r.rule, r.verdict) == (said[0], said[1] or ("block" if u in parent and find(u) in bad else "allow")), u


def test_rules_of_equal_length(spark):
    rules = (("a.org/x", "block"), ("a.org/x", "allow"), ("b.org/y", "block"), ("org/abc", "allow"))
    df = spark.createDataFrame([(1, "http://a.org/x1", ""), (2, "http://b.org/y", ""), (3, "http://c.org/abc", "")], "page_id long, url string, html string")
    for few in (url_filter.FEW, 0):
        assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df, rules, few).collect()} == {1: ("a.org/x", "allow"), 2: ("b.org/y", "block"), 3: ("org/abc", "allow")}


def test_lookup(spark):
    """A hot key, common ones and missing ones, against a plain join."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).cast("long").alias("a"), F.col("id").alias("x"))
    table = rows.groupBy("a").agg(F.count("*").alias("n"), F.max("x").alias("most")).where("a % 2 = 1")
    want = {(r.a, r.x, r.n, r.most) for r in rows.join(table, "a").collect()}
    got = common.lookup(rows, table, ["a"], "n")
    assert got.columns == ["a", "x", "n", "most"] and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    got = common.lookup(rows, table, ["a"], "n")
    plan = got._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"hashpartitioning\(a#\d+L, k_deal#\d+L", plan)


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(1000, 1080)] + [(5000, i) for i in range(2000, 2100)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.v: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


def test_lines(spark, sf, odd, none):
    rows = documents(spark, sf).select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text"))
    for r in quality_rules.clean_lines(rows).join(rows.select("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id is None:
            continue
        w, text = words(r.text), r.text or ""
        runs = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        inside = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, r.doc_id
        assert not (r.base_failed and r.kept)
    assert quality_rules.clean_lines(none).count() == 0


def test_line_rules(spark):
    body = "\n".join(f"This is sentence number {i} of the text, part{i} of it fine{i}." for i in range(8))
    junk = body + "\nhome | about | news | help\nAll rights reserved, 2026.\nThis is sentence number 1 of the text, part1 of it fine1.\n##%% $$ &&"
    spam = "home | about | news | help | more\n" * 9 + "One fine sentence at the end of it."
    got = quality_rules.clean_lines(spark.createDataFrame([(1, body), (2, junk), (3, spam)], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].kept, by[1].lost_words, by[1].clean_text) == (True, 0, body)
    assert by[2].clean_text == body + "\n" and by[2].kept
    assert not by[3].kept


def judged(text):
    """Words in failing lines, and the text without them, by the rules one line at a time."""
    q, lines, seen, lost, left = quality_rules, text.split("\n"), set(), 0, []
    filled = sum(bool(words(x)) for x in lines)
    for i, line in enumerate(lines):
        w = words(line)
        bad = line in seen
        if w:
            seen.add(line)
            bad |= sum(c in "#*$%&|<>" for c in line) * q.SYMBOL_SHARE > len(line)
            bad |= len(w) <= q.FRAGMENT and w[-1][-1] not in ".!?,;:)\"'" and filled > 1
            bad |= sum(x in q.SEPARATOR_WORDS for x in w) >= q.SEPARATORS
            low = re.sub("[A-Z]+", lambda m: m[0].lower(), line)
            bad |= len(w) <= q.FURNITURE and any(re.search(rf"(?<![0-9a-z\x80-\U0010ffff]){re.escape(p)}(?![0-9a-z\x80-\U0010ffff])", low) for p in q.PHRASES)
        if w and bad:
            lost += len(w)
        else:
            left.append(line + "\n" * (i < len(lines) - 1))
    return lost, "".join(left)


def test_lost_words(spark, sf, odd):
    """lost_words, kept and clean_text of whole tables and of lines on both sides of every rule."""
    made = [
        "He signed design upgrades and found the catalog in a drawer of the study.\nA dialog in the garden went on for hours, they said.",
        "Please log in\nLog in to go on.\nclick here!\nCLICK HERE for more\nTous droits réservés 2024.\nWeiterlesen über\nLeer más",
        "a | b | c\na | b\n" + "all rights reserved " * 10 + "\nshort line\nshort line,\n### $$$ x\n\n \nshort line,",
        "übersign upé",
        "one " * 30 + "\n" + "the second line is not long.\n" * 5,
    ]
    rows = documents(spark, sf).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    for r in quality_rules.clean_lines(rows).join(rows.withColumnRenamed("text", "raw"), "doc_id").collect():
        lost, left = judged(r.raw or "")
        assert (r.lost_words, r.clean_text) == (lost, left), r.doc_id
        assert r.kept == (not r.base_failed and lost <= quality_rules.MAX_LOSS * r.n_words)


def thue_morse(n):
    """A string of 2**n letters and the string with the two letters changed for one another: sums of powers of an odd
    number over them agree modulo 2**64 from 2**10 letters on."""
    out = "a"
    for _ in range(n):
        out += out.translate({97: 98, 98: 97})
    return out, out.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [8, 10, 12])
def test_patterns_that_sums_of_powers_confuse(spark, n):
    a, b = thue_morse(n)
    made = [a, b, f"{a} x y", f"{b} x y", f"{a}\n{b}\n{a[::-1]}c", f"{a}c {b}c {a}d"]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90, 100).collect()}
    assert got == linked(list(enumerate(made)), 3, 90, 100) and len({c for _, c in got.values()}) == len(made)
    assert all(r.n_dup_lines == 0 and r.n_repeat_words == 0 for r in quality_rules.clean_lines(df).collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, texts=False).collect()}
    assert got == dict(enumerate(cut([t.encode() for t in made])))


def test_hashes_of_ranges():
    """The same for equal bytes wherever they stand, up to and beyond the length that goes to BLAKE2."""
    text = np.frombuffer(bytes(range(256)) * 5, np.uint8)
    h = scan.Hashes(text)
    for size in (0, 1, 7, 8, 9, 200, scan.LONG, scan.LONG + 1):
        at = np.arange(0, 256)
        one, two = h.of(at, at + size), h.of(at + 256, at + 256 + size)
        assert (one == two).all() and len(set(one.tolist())) == (256 if size else 1)
    for k in (8, 9, 16, 100, 200):
        g = scan.grams(text, k)
        assert len(g) == len(text) - k + 1 and (g[:256] == g[256:512]).all() and len(set(g.tolist())) == 256


# 4


def test_licences(spark):
    files = spark.createDataFrame(
        [
            (1, "p/LICENSE", "Released under the MIT License."),
            (2, "p/src/a.py", "x = 1"),
            (3, "p/src/b.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 50),
            (4, "p/lib/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (5, "p/lib/deep/er/c.py", "y"),
            (6, "q/d.py", None),
            (7, None, "z"),
            (8, "e.py", "copyright nobody in particular of anything at all whatever"),
        ],
        "f_id long, path string, text string",
    )
    got = {r.f_id: (r.own_license, r.license, r.inherited_from) for r in license_scan.scan(files).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "MIT", "p"), 3: ("Apache-2.0", "Apache-2.0", None), 4: ("GPL-3.0", "GPL-3.0", None), 5: (None, "GPL-3.0", "p/lib"), 6: (None, None, None), 7: (None, None, None), 8: (None, None, None)}
    assert license_scan.scan(files.where("1 = 0")).count() == 0


def test_headers_of_many_lines(spark):
    """File notices in comment blocks, tags, and headers on odd rows."""
    t = dict(license_scan.TEMPLATES)  # the last of each licence: the notice of files
    block = lambda text, mark: "\n".join(f"{mark} {text[i : i + 70]}" for i in range(0, len(text), 70))
    code = "\nint main() { return 0; }\n" * 20
    rows = [(i, f"a{i}/x.c", f"{mark} Copyright 2020 Some Body\n{block(t[name], mark)}{code}") for i, (name, mark) in enumerate([("GPL-3.0", "//"), ("GPL-2.0", " *"), ("MIT", "#"), ("BSD-3-Clause", "--"), ("Apache-2.0", ";"), ("LGPL-3.0", "*"), ("MPL-2.0", "//"), ("BSD-2-Clause", "#")])]
    want = ["GPL-3.0", "GPL-2.0", "MIT", "BSD-3-Clause", "Apache-2.0", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause"]
    rows += [(20, "b/x.py", "# SPDX-License-Identifier: BSD-3-Clause\nx = 1"), (21, "c/x.py", "/* spdx-license-identifier: Zlib */" + code), (22, "d/x", "This license plate is rusty, and the copyright page is torn.")]
    rows += [(30, "b/x.py", "again"), (30, "b/x.py", "again"), (None, None, "Released under the MIT License."), (31, "z/y/x.py", None), (32, "", "# SPDX-License-Identifier: MIT")]
    names = ("line", "n", "key", "held", "own_license", "license", "folder", "up", "k_heavy", "files", "t")
    df = spark.createDataFrame(rows, "f_id long, path string, text string").select("*", *(F.lit(1).alias(n) for n in names))
    got = collections.defaultdict(list)
    for r in license_scan.scan(df).collect():
        got[r.f_id].append((r.own_license, r.license, r.inherited_from))
    assert [got[i] for i in range(8)] == [[(x, x, None)] for x in want]
    assert got[20] == [("BSD-3-Clause", "BSD-3-Clause", None)] and got[21] == [("Zlib", "Zlib", None)]
    assert got[22] == [(None, "MIT", "")] and got[32] == [("MIT", "MIT", None)]
    # a file that is mostly its licence speaks for its folder, and one at the root for all that have none nearer
    assert got[30] == [(None, "BSD-3-Clause", "b")] * 2 and got[31] == [(None, "MIT", "")] and len(got[None]) == 1


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no texts to read")
def test_licence_files(spark):
    """Whole licence texts, reflowed and under a copyright line; short notices; a licence's text in a file of another name."""
    names = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause"}
    rows, want = [], {}
    for i, (name, license_) in enumerate(names.items()):
        with open(f"{COMMON}/{name}", encoding="utf-8") as f:
            text = "Copyright (c) 2020 Some Body and others\n\n" + " ".join(f.read().split())
        rows += [(2 * i, f"{name}/LICENSE", text), (2 * i + 1, f"{name}/src/a.c", "int x;")]
        want |= {2 * i: (license_, license_, None), 2 * i + 1: (None, license_, name)}
    prose = "The committee met in the afternoon, and it was agreed that the members would receive the minutes of the meeting. " * 40
    rows += [(100, "n/COPYING", "Released under the MIT License."), (101, "o/NOTICE", prose), (102, "r/readme.txt", rows[-2][2].partition("\n")[2]), (103, "s/LICENSE", None)]
    want |= {100: ("MIT", "MIT", None), 101: (None, None, None), 102: ("BSD-3-Clause", "BSD-3-Clause", None), 103: (None, None, None)}
    got = license_scan.scan(spark.createDataFrame(rows, "f_id long, path string, text string")).collect()
    assert {r.f_id: (r.own_license, r.license, r.inherited_from) for r in got} == want
    assert len(got) == len(rows)


# 5


def linked(rows, k, num, den):
    sets = {}
    for i, text in rows:
        w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    holders, parent = collections.defaultdict(list), {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in holders[x]).items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num", "leaf"), [(3, 90, 2048), (5, 80, 4)])
def test_jaccard(spark, sf, k, num, leaf):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).select("doc_id", "text").collect()]
    for i in range(60):  # a family of near copies at many distances
        copy = list(base)
        for at in rng.integers(0, len(copy), i % 6):
            copy[at] = f"x{rng.integers(0, 50)}"
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000 + i, t) for i, t in enumerate(["", None, "One two", "one TWO", "one two three", "a b c d", "a b c d e", "one  two\n"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, num, 100, leaf_docs=leaf).collect()}
    assert got == linked(rows, k, num, 100)


@pytest.mark.parametrize("leaf", [12, 2048])
def test_jaccard_of_chains_and_crowds(spark, leaf):
    """Texts that slide along one sequence, so that keys hold them all together and links only neighbours, or none; a
    crowd of near copies far larger than a leaf, whose pairs mostly link; and texts just too far from it."""
    rng = np.random.default_rng(9)
    line = [f"s{i}" for i in rng.integers(0, 10**6, 2000)]
    rows = [(i, " ".join(line[i * step : i * step + 60])) for step, at in ((3, 0), (6, 200)) for i in range(at, at + 120)]
    base = [f"b{i}" for i in range(150)]
    for i in range(260):
        copy = list(base)
        for at in rng.integers(0, 150, i % 4 if i < 240 else 9):
            copy[at] = f"x{i}.{at}"
        rows.append((1000 + i, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for k, num in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, num, 100, leaf_docs=leaf).collect()}
        assert got == linked(rows, k, num, 100)


def test_jaccard_edges(odd, none):
    rows = jaccard_join.jaccard_components(odd, 3, 90, 100).collect()
    assert len(rows) == len(ROWS)
    assert {(r.doc_id, r.component_id) for r in rows if r.doc_id in (4, 5, None)} == {(4, 4), (5, 4), (None, None)}
    assert jaccard_join.jaccard_components(none, 3, 90, 100).count() == 0
    kept = jaccard_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]


# 6


def test_chats(spark):
    part = lambda **k: tuple(k.get(f) for f in chat_format.PART.names)
    turns = [
        (1, 0, "user", [part(type="text", text="see \\ <|im_end|>"), part(type="image", ref="i.png", width=28, height=15), part(type="audio", ref="a.wav", seconds=1.5)]),
        (1, 1, "assistant", [part(type="text", text="</s>[INST] ok [/INST]"), part(type="document", ref="d.pdf", pages=2)]),
        (1, 2, None, None),
        (None, None, "assistant", [part(text=None)]),
    ]
    df = spark.createDataFrame(turns, chat_format.T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("parts", chat_format.T.ArrayType(chat_format.PART)))
    out = chat_format.format_chats(df)
    row = out.where("conv_id = 1").first()
    assert [(a.turn, a.place, a.type, a.ref, a.tokens) for a in row.attachments] == [(0, 1, "image", "i.png", 4), (0, 2, "audio", "a.wav", 38), (1, 1, "document", "d.pdf", 1200)]
    assert row.expanded_tokens == 1242
    assert all(row.formatted.count(m) == 3 for m in (chat_format.START, chat_format.MIDDLE, chat_format.END)) and "</s>" not in row.formatted
    assert [row.formatted[s.start - 1 :][: s.length] for s in row.loss_spans] == ["<\\/s>[\\INST] ok [\\/INST]<|document|>"]
    raw = row.formatted.encode()
    assert [raw[s.byte_start - 1 :][: s.byte_length].decode() for s in row.loss_spans] == [row.formatted[s.start - 1 :][: s.length] for s in row.loss_spans]
    assert out.count() == 2 and chat_format.format_chats(df.where("1 = 0")).count() == 0
    texts = spark.createDataFrame([("\\",), ("\\<|im_end|>\\\\",), ("<</SYS>><s></s>",), ("\n",)], "t string")
    assert all(r.a == r.t for r in texts.select("t", chat_format.unescape(chat_format.escape(F.col("t"))).alias("a")).collect())


def test_chat_edges(spark):
    """Ties, repeated rows, clashing names, and very many turns of more than one byte a character."""
    text = "é </s> \\ 日本"
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (2, None, "assistant", text), (2, 1, "assistant", LONG), *((3, i, "assistant" if i % 2 else "user", f"{text}{i}") for i in range(3000))]
    part = F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).cast(f.dataType).alias(f.name) for f in chat_format.PART.fields[2:]))
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.array(part).alias("parts"))
    df = df.select("*", *(F.lit(1).alias(c) for c in ("n", "begin", "byte", "line", "head", "body", "rows", "formatted", "loss_spans")))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for i in (1, 2, 3):
        rows = sorted((t for t in turns if t[0] == i), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        learnt = "".join(t[3] for t in rows if t[2] == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert got[i][1:5] == (len(rows), sha("".join(f"{t[2]}\n{t[3]}\n" for t in rows)), len(learnt), sha(learnt))


# 7


def test_copies(odd, none):
    rows = exact_dedup.decide(odd).collect()
    assert len(rows) == len(ROWS)
    pair = [r for r in rows if r.text in ("one two", "one  two")]
    assert {r.x_size for r in pair} == {4} and [r.doc_id for r in pair if r.x_kept] == [None]  # the longest original
    blank = [r for r in rows if not (r.text or "").strip()]
    assert {r.x_size for r in blank} == {3} and [r.doc_id for r in blank if r.x_kept] == [3]
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    assert exact_dedup.decide(none).count() == 0


def test_columns_of_any_name_come_back(spark):
    """Every name that a stage of the pipeline uses inside, as a column of the documents."""
    inner = [f"{p}{c}" for p, cs in (("x_", ("sha", "chars", "maybe", "row", "bit", "map", "rid", "best", "size", "keep_id", "kept")), ("m_", ("size", "source", "id", "key", "bin", "plan", "source_size", "target", "epochs", "budget", "bound", "before", "in", "times", "quality"))) for c in cs]
    inner += ["k_heavy", "k_light", "k_deal", "k_found", "k_total", "component_id", "label", "n", "words", "X_SHA2"]
    df = spark.createDataFrame([(i, f"text number {i % 7} " * 30, "en", "ab"[i % 2], 1) for i in range(40)], SCHEMA)
    df = df.select("*", *(F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in inner))
    rows = {r.doc_id: r for r in df.collect()}
    for step in (exact_dedup.drop_copies, source_mixing.repeat_taken, jaccard_join.keep_one_of_each):
        out = step(df)
        assert out.columns == df.columns
        found = out.collect()
        assert found and all(r == rows[r.doc_id] for r in found), step
    assert len(exact_dedup.drop_copies(df).collect()) == 7


def test_filter_is_never_wrong(spark, sf):
    docs = documents(spark, sf)
    hashed = common.stage(exact_dedup.with_hash(docs))
    maybe = exact_dedup.suspects(hashed, hashed)
    repeated = maybe.groupBy("x_sha").agg(F.count("*").alias("n"), F.min("x_maybe").alias("all")).where("n > 1")
    assert repeated.count() > 0 and repeated.where("not all").count() == 0
    assert maybe.where("x_maybe").count() < docs.count() / 2


def test_hot_text(spark):
    """A third of all rows is one text; its rows are dealt over tasks."""
    df = spark.createDataFrame([(i, "hot text" + " " * (i % 4) if i % 3 == 0 else f"text {i // 2}") for i in range(6000)], "doc_id long, text string")
    got = {r.doc_id: (r.x_keep_id, r.x_size, r.x_kept) for r in exact_dedup.decide(df, texts=False).collect()}
    groups = collections.defaultdict(list)
    for r in df.collect():
        groups[r.text.replace(" ", "")].append((-len(r.text), r.doc_id))
    want = {i: (min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g}
    assert got == want


# 8


def cut(rows, n=200):
    seen = collections.Counter(t[i : i + n] for t in rows for i in range(len(t) - n + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeats(spark, sf, hot):
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("abcdefgh é"), 700))
    rows = [r.text for r in documents(spark, sf).select("text").limit(80).collect()]
    rows += ["".join(rng.choice(list("xyz "), int(rng.integers(0, 90)))) + passage[a : a + int(rng.integers(150, 500))] for a in rng.integers(0, 300, 40)]
    rows += ["a" * 1000, "ab" * 150, "", None, "short", passage[:200], passage[100:300] * 2]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, texts=False, hot=hot).collect()}
    assert got == dict(enumerate(cut([(t or "").encode() for t in rows])))


def test_repeats_edges(odd, none, monkeypatch):
    rows = suffix_dedup.suffix_dedup(odd).collect()
    assert len(rows) == len(ROWS) and next(r for r in rows if r.doc_id == 4).kept == b"one two"
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_long_texts_are_cut_alike(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 5000, dtype=np.uint8))
    whole = {(i, int(g)) for _, _, lo, hi, g, _ in zip(*suffix_dedup.anchors(*scan.view(pa.array([text], pa.binary()), 0, 1)), strict=True) for i in range(lo, hi + 1)}
    parts = {(i + begin, int(g)) for _, _, buf, offsets, begin in suffix_dedup._cuts(pa.array([text], pa.binary())) for _, _, lo, hi, g, _ in zip(*suffix_dedup.anchors(buf, offsets), strict=True) for i in range(lo, hi + 1)}
    assert whole == parts


# 9


def subsequence_kernel(s, t):
    def vector(w):
        out = collections.Counter()
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + toxicity.SPAN)):
                    out[w[i] + w[j] + w[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    a, b = vector(s), vector(t)
    norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    return sum(x * b[c] for c, x in a.items()) / norm if norm else 0.0


def units(*texts):
    raw = [t.encode() for t in texts]
    return toxicity.fold(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))


def test_kernel():
    names = ["idiot", "idixot", "worthless", "banana", "ab"]
    u = units(" ".join(names))
    table = toxicity.features(u.letters[: u.first[-2]], u.first[:-1])
    got = toxicity.kernel(u.letters, u.first, table)
    want = [[subsequence_kernel(a, b) ** toxicity.POWER for b in names[:-1]] for a in names]
    assert np.allclose(got, want, atol=1e-5)


def test_folding():
    u = units("i.d.i.o.t ID1OT ídïöt", "i d i o t", "", "x")
    letters = ["".join(chr(96 + c) for c in u.letters[a:b]) for a, b in zip(u.first, u.first[1:], strict=False)]
    assert letters == ["idiot", "idiot", "idiot", "idiot", "x"] and u.row.tolist() == [0, 0, 0, 1, 3]


def test_second_reading():
    raw = ["idíot plain über", "ñ", "", "é"]
    texts = [t.encode() for t in raw]
    u = toxicity.readings(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts]))))
    words = [u.letters[a:b].tolist() for a, b in zip(u.first, u.first[1:], strict=False)]
    plain = [[ord(c) - 96 for c in w] for w in ("idiot", "plain", "uber", "n", "e")]
    assert words[:5] == plain and words[5:] == [[9, 4, 30, 15, 20], [27, 2, 5, 18], [29]]
    assert u.row.tolist() == [0, 0, 0, 1, 3, 0, 0, 3]


def test_toxicity(spark, sf, odd, none):
    rng = np.random.default_rng(2)
    clean = ["the weather is mild", "trains leave on time", "she reads a book", "water boils at sea level", "markets open early", "the garden grows"]
    bad = ["what an idiot you are", "such a moron", "you worthless clown", "pathetic loser"]
    rows = [(i, ". ".join([*rng.choice(clean, 5), *(rng.choice(bad, 2) if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = toxicity.score(df, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and all((r.score >= 0.5) == bool(r.toxic) for r in held)
    score = lambda t: float(model.score(model.worst(units(t), 1))[0])
    assert all(score(f"the {w} reads a book") >= 0.5 for w in ("idiot", "i.d.i.o.t", "id1ot", "m o r o n", "w0rthless", "pathe-tic"))
    assert all(score(t) < 0.5 for t in ("", "the ocean is calm", *clean))
    # what is scored at once is what each word scores alone
    u = units("the idiot and the banana")
    alone = [model.values(u.letters[a:b], np.array([0, b - a]))[0] for a, b in zip(u.first, u.first[1:], strict=False)]
    assert np.isclose(model.worst(u, 1)[0], max(model.floor, max(alone)), atol=1e-4)
    rows = toxicity.drop_toxic(odd, model)
    assert rows.columns == odd.columns and rows.count() == len(ROWS) and toxicity.drop_toxic(none, model).count() == 0
    never = toxicity.fit(none.select("doc_id", "text"), df.select("doc_id", "toxic").where("1 = 0"))
    assert toxicity.score(df, never).where("score > 1e-9").count() == 0


INSULTS = "idiot moron loser clown scum trash stupid pathetic worthless disgusting fool jerk creep coward vermin parasite imbecile dimwit scoundrel numbskull".split()


def test_inserted_letters(spark):
    """A letter inserted at each place of 20 insults, and sentences of clean words alone, held-out ones among them."""
    rng = np.random.default_rng(4)
    syllables = ["the", "an", "er", "ing", "on", "re", "at", "en", "th", "or", "es", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le", "ve", "co", "me", "de"]
    vocabulary = sorted({"".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(3000)} - set(INSULTS))
    sentence = lambda: " ".join(rng.choice(vocabulary, 12)).capitalize() + "."
    rows = []
    for i in range(1500):
        said = [sentence() for _ in range(5)]
        if i % 4 == 0:
            said[2] = f"You are a {rng.choice(INSULTS)} and a {rng.choice(INSULTS)}."
        rows.append((i, " ".join(said), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    spoilt = [f"She said {w[:j]}{c}{w[j:]} to him" for w in INSULTS for j in range(1, len(w)) for c in rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3, replace=False)]
    score = lambda texts: model.score(model.worst(units(*texts), len(texts)))
    assert (score(spoilt) >= 0.5).mean() >= 0.9
    clean = [sentence() for _ in range(1000)]
    assert (score(clean) >= 0.5).mean() <= 0.02
    held = [r for r in toxicity.score(df, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in held]) >= 0.95


# 10

TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoding():
    e = packing.Encoder(TOKENIZER)
    assert e.fast is not None
    for t in ["", "a", " ", "  x \n\n y", "<|endoftext|>", "it's I'LL  don't", "é ñ  ü", "日本語 テキスト", "x" * 3000, " " * 500, "\r\n\t a"]:
        assert e.encode(t) == e._whole(t)


def test_encoding_of_long_white_space(spark):
    """The faster merger fails on a million of white space in a row."""
    e = packing.Encoder(TOKENIZER)
    texts = [" " * 1_000_000, "a" + "\n" * 1_000_000 + "b", "\u3000" * 1_000_000, "x" + " \t" * 600_000 + "y", "after it"]
    for t in texts:
        assert e.encode(t) == e._whole(t)
    assert e.fast is not None
    docs = dict(enumerate(texts[:2] + texts[-1:]))
    check_packing(packing.pack_documents(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), TOKENIZER).collect(), docs)


@pytest.mark.parametrize("n", [0, 1, 50, 3000])
def test_plan(n):
    rng = np.random.default_rng(n)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6, 1.2, n).astype(int)))
    counts = np.bincount(lengths, minlength=2049)
    plan, used = packing.pack(counts), np.zeros(2049, int)
    for window, times in plan:
        assert sum(a * b for a, b in window.items()) <= 2048
        for a, b in window.items():
            used[a] += b * times
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= 1.01 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("masses", [{1024: 1000}, {1000: 1000}, {682: 999}, {512: 1000}, {409: 1000}, {1100: 500, 948: 500}, {1024: 1000, **dict.fromkeys(range(1030, 2040), 1)}, dict.fromkeys(range(824, 1025), 10)])
def test_plan_of_hot_lengths(masses):
    """Pieces of a few lengths, on both sides of the window's divisors, alone and among others."""
    counts = np.zeros(2049, int)
    for length, n in masses.items():
        counts[length] = n
    plan, used = packing.pack(counts), np.zeros(2049, int)
    for window, times in plan:
        assert sum(a * b for a, b in window.items()) <= 2048
        for a, b in window.items():
            used[a] += b * times
    assert (used == counts).all()
    # what any plan needs: windows for all tokens, for the pieces of half a window or more, or for as many as fit side by side
    least = max(-(-int(counts @ np.arange(2049)) // 2048), int(counts[1025:].sum()) + -(-int(counts[1024]) // 2), -(-int(counts.sum()) // (2048 // min(masses))))
    assert sum(t for _, t in plan) <= 1.01 * least + 1


def check_packing(rows, docs):
    """Every document's ids are whole, cut as told, and sequences are gapless."""
    e = packing.Encoder(TOKENIZER)
    by, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, text in docs.items():
        ids = e.encode(text or "") + b"\0\0\0\0"
        n, pieces = len(ids) // 4, sorted(by[doc_id], key=lambda r: (r.piece, r.sequence_id))
        pieces = list({r.piece: r for r in pieces}.values())
        assert sum(r.length for r in pieces) == n
        for i, r in enumerate(pieces):
            assert (r.piece, r.ids_crc32) == (i, zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]))
            assert r.length == 2048 or i == 0


def test_packing(spark, sf, odd, none):
    docs = documents(spark, sf)
    rows = packing.pack_documents(docs, TOKENIZER).collect()
    check_packing(rows, {r.doc_id: r.text for r in docs.collect()})
    assert len({r.sequence_id for r in rows}) <= sum(r.length for r in rows) / 2048 + 2
    check_packing(packing.pack_documents(odd, TOKENIZER).collect(), {r[0]: r[1] for r in ROWS})
    assert packing.pack_documents(none, TOKENIZER).count() == 0


# the pipeline


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = documents(spark, sf)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    now, kept = docs, []
    for _, step in pipeline.STAGES[:-1]:
        now = common.stage(step(spark, now, sf))
        assert now.columns == docs.columns
        kept.append([(r.doc_id, r.text) for r in now.select("doc_id", "text").collect()])
    plain, near, mixed = kept[1], kept[2], kept[3]
    assert len({SPACE.sub("", t or "") for _, t in kept[0]}) == len(plain)
    groups = linked(plain, 5, 80, 100)
    assert sorted(i for i, _ in near) == sorted(i for i, (_, root) in groups.items() if i == root)
    assert {i for i, _ in mixed} <= {i for i, _ in near}
    rows = pipeline.run(spark, sf).collect()
    check_packing(rows, dict(mixed))
    assert len([r for r in rows if r.piece == 0]) == len(mixed)


def test_pipeline_of_odd_tables(spark, odd, none, tmp_path):
    """Nulls, blank, repeated and very long texts with columns of any names, labels that tell nothing, and no rows."""
    import corpus_pipeline as pipeline

    for name, docs in (("odd", odd), ("none", none)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, step in pipeline.STAGES[:-1]:
            now = common.stage(step(spark, now, f"{tmp_path}/{name}"))
            assert now.columns == docs.columns
        rows = pipeline.run(spark, f"{tmp_path}/{name}").collect()
        kept = {r.doc_id: r.text for r in now.collect()}
        assert set(kept) == ({None, 6, 7} if name == "odd" else set())
        check_packing(rows, kept)


def test_nothing_staged_is_left(spark, sf):
    """What a query stages on its way is gone with its result there."""
    for name in ("op1_source_mixing", "op2_url_filter", "op4_license_scan", "op7_exact_dedup"):
        before = len(common._staged)
        entry.queries()[name](spark, sf)
        assert len(common._staged) == before + 1, name
