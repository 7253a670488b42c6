"""The trie against a search of all rules."""

import random
import time

import pytest

from millrace.llm import urls


def brute(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host), len(r.path), r.verdict == "block"), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


URLS = [
    None, "", "no scheme/at all", "http://", "http://Net", "http://net/", "http://a.NET/x", "https://example.net/en/1", "https://example.net/en", "https://wwwexample.net/en/",
    "http://x.example.com/de/?q=/", "http://example.com#/de/", "ftp://org/fr/", "http://a.org/fr/x#y", "a://b://net/", "http://net:80/", "http://u@net/", "http://ÉX.net/", "http://.net/", "http://net./",
    "x\ny://a.net/\nz", "http://" + "a." * 5000 + "net/" + "b/" * 5000,
]


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("chars", [10**6, 60])
def test_equals_brute_force(spark, seed, chars, monkeypatch):
    monkeypatch.setattr(urls, "TRIE_CHARS", chars)
    rng = random.Random(seed)
    labels, segments = ["net", "org", "a", "b", "example"], ["", "en", "e", "x", "en2"]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(segments) for _ in range(rng.randint(0, 4)))
    rules = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "a", ""), urls.Rule("block", "org", "/e"), urls.Rule("allow", "org", "/e")]
    rules += [urls.Rule(rng.choice(["allow", "block"]), host(), path()) for _ in range(40)]
    rules = list({(r.host, r.path): r for r in sorted(rules)}.values())
    rows = list(enumerate(URLS + [f"http://{host()}{path()}{rng.choice(['', '?x', '#y'])}" for _ in range(300)])) + [(0, "http://net/"), (None, "http://net/")]
    pages = spark.createDataFrame([(i, u, "h", "p", "v") for i, u in rows], "page_id long, url string, host string, path string, verdict string").repartition(3)
    got = urls.judge(pages, rules).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str((i, *brute(u, rules))) for i, u in rows)
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, [], default="block").collect()} == {"block"}


def test_block_stands_over_allow():
    trie = urls.Trie([urls.Rule("block", "a", "/"), urls.Rule("allow", "a", "/")])
    assert trie.find("x.a", "/y").verdict == "block"


def test_long_paths_take_linear_time():
    trie = urls.Trie([urls.Rule("block", "net", "/abc"), urls.Rule("allow", "net", "/aaaa"), urls.Rule("block", "net", "/a/b")])
    began = time.process_time()
    assert trie.find("x.net", "/" + "a" * 10**6).path == "/aaaa"
    assert trie.find("x.net", "/b" * 500_000) is None
    assert time.process_time() - began < 5
