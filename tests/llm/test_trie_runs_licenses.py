"""Operators 11 to 13 against brute-force versions, and on nulls, empty and very long texts, ties, repeats, odd columns and empty tables."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from duebook.llm import license_scan, periodic_runs, prefix_trie

CHATS = "conv_id long, turn long, role string, text string"
TEXTS = "doc_id long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# prefix trie
def chats(seed=1, n=60):
    """Few unlike turns, so prefixes are shared; nulls, ties, repeats, gaps, a hot conversation and a long one."""
    r = random.Random(seed)
    out = []
    for c in [*range(n), 1_000_003, 1_000_005]:
        if r.random() < 0.1:
            continue
        for k in range(r.randint(1, 12)):
            out.append((c, r.choice([k, k, k, None, 3]), r.choice(["user", "user", None]), r.choice(["a", "é", "", None, "b" * 50])))
    out += [(c, k, "user", "the same") for c in range(2000, 2080) for k in range(10)]
    out += [(5000, k // 2, "user", f"t{k % 7}") for k in range(3000)] + [(5001, k, "user", "x" * 200_000) for k in range(2)]
    out += [(None, 1, "user", "nobody's"), out[0], out[0], (7777, None, None, None)]
    return out


def brute_trie(turns):
    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    said = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = [*said.get(c - c % 5, [])[:h], *said[c][h:]]
    # nodes by number; a trie of dicts
    children, members, size, ends = [{}], [[]], [0], [[]]
    for c, turns_ in sorted(built.items()):
        at = 0
        members[0].append(c)
        for turn in turns_:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                members.append([])
                ends.append([])
                size.append(len(turn[1].encode()))
            at = children[at][turn]
            members[at].append(c)
        ends[at].append(c)
    leaves, saved = [0] * len(children), [0] * len(children)
    for k in reversed(range(len(children))):  # children have larger numbers
        below = children[k].values()
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = (len(members[k]) - 1) * size[k] + sum(saved[x] for x in below)
    depth, above = {0: 0}, {0: None}
    for k in range(len(children)):
        for x in children[k].values():
            depth[x], above[x] = depth[k] + 1, min(members[k])
    return [] if not built else [
        (min(members[k]), depth[k], above[k], len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
        for k in range(len(children))
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force_and_sql(spark, seed):
    data = chats(seed)
    table = spark.createDataFrame(data, CHATS).repartition(3)
    want = sorted(brute_trie(data), key=repr)
    assert rows(prefix_trie.op11(table)) == want
    if seed == 2:
        return
    duck = duckdb.connect()
    frame = table.where("conv_id <> 5000").toPandas()  # noqa: F841  window strings grow with the square of a conversation's turns
    duck.execute("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM frame")
    assert sorted(duck.sql(prefix_trie.SQL).fetchall(), key=repr) == sorted(brute_trie([x for x in data if x[0] != 5000]), key=repr)


def test_trie_of_blocks_chunks_and_odd_columns(spark, monkeypatch):
    data = chats(3)
    table = spark.createDataFrame(data, CHATS)
    plain = rows(prefix_trie.op11(table))
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    odd = table.withColumns({c: F.lit("x") for c in ("place", "digest", "depth", "k1", "bytes", "weight", "h", "head", "t__a", "one", "ends_sha256")})
    assert rows(prefix_trie.op11(odd)) == plain == sorted(brute_trie(data), key=repr)
    assert prefix_trie.op11(table.limit(0)).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    """An absent head and few turns of its own leave a conversation without turns."""
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    found = prefix_trie.op11(spark.createDataFrame([(c, 1, "user", "a")], CHATS)).collect()
    assert [tuple(r) for r in found] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# periodic runs
def brute_runs(w):
    found = {}
    for q in range(1, len(w)):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic_words(r):
    k = r.choice([1, 2, 3, 5, 30])
    w = [f"w{r.randrange(k)}" for _ in range(r.randrange(0, 60))]
    for _ in range(r.randrange(4)):
        p = [f"w{r.randrange(k + 2)}" for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 17, 31]))]
        p = (p * r.randrange(1, 9))[: r.randrange(1, 300)]
        at = r.randrange(len(w) + 1)
        w[at:at] = p
    return (w * r.randrange(1, 6) if r.random() < 0.3 else w)[:400]


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        w = [x.encode() for x in periodic_words(r)]
        assert periodic_runs.find_runs([w, [b"a"] * 3, [], w]) == [brute_runs(w), [], [], brute_runs(w)]


def test_long_periodic_texts_take_linear_time():
    r = random.Random(6)
    period = [str(r.random()).encode() for _ in range(40_000)]
    assert periodic_runs.find_runs([period * 5]) == [[(0, 200_000, 40_000)]]
    assert periodic_runs.find_runs([[b"a"] * 200_000]) == [[(0, 200_000, 1)]]


def brute_op12(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute_runs(w)
    drop = {k for s, size, q in found for k in range(s + q, s + size)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            digest(" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_op12_equals_brute_force(spark):
    r = random.Random(7)
    data = [(k, r.choice([" ", "\n", " \t", " "]).join(periodic_words(r))) for k in range(400)]
    data += [(500, None), (501, ""), (502, " \n\t\x0b\x0c\r"), (503, "é é é é " * 5), (504, "a " * 600), (505, " ".join(f"u{k}" for k in range(2000))), (1, data[1][1]), (1, data[1][1])]
    table = spark.createDataFrame(data, TEXTS).withColumns({c: F.lit("x") for c in ("runs", "start", "length", "words", "d__runs")})
    assert rows(periodic_runs.op12(table.repartition(3))) == sorted((brute_op12(*x) for x in data), key=repr)
    assert periodic_runs.op12(table.limit(0)).collect() == []


def test_runs_and_collapsed_texts(spark):
    table = spark.createDataFrame([(1, "so no no no no no no more", "y"), (2, None, "y")], f"{TEXTS}, runs string")
    found = {r["doc_id"]: r for r in periodic_runs.periodic_runs(table, "doc_id").collect()}
    assert [tuple(x) for x in found[1]["runs"]] == [(1, 6, 1)] and found[1]["collapsed"] == "so no more"
    assert found[2]["runs"] == [] and found[2]["collapsed"] == ""


def test_null_ids_get_no_periodic_end(spark):
    assert rows(periodic_runs.op12(spark.createDataFrame([(None, "a b c d e f g h")], TEXTS)))[0][:2] == (None, 0)


# license scan
def least_edits(notice, words, most):
    """The fewest edits between the notice and a stretch of whole words that holds the words it must."""
    n, best = len(notice), None
    for i in range(len(words)):
        text = " ".join(words[i:])[: n + most + 1]
        before = list(range(n + 1))
        for j, c in enumerate(text, 1):
            now = [j]
            for x in range(1, n + 1):
                now.append(min(before[x] + 1, now[x - 1] + 1, before[x - 1] + (notice[x - 1] != c)))
            before = now
            whole = " ".join(words[i:])
            if (j == len(whole) or whole[j] == " ") and now[n] <= most and license_scan.EXACT & set(notice.split()) <= set(text[:j].split()):
                best = now[n] if best is None else min(best, now[n])
    return best


def edited(r, notice):
    w = list(notice)
    for _ in range(r.randrange(0, license_scan.allowed(notice) + 3)):
        p, x = r.randrange(len(w)), r.random()
        if x < 0.4:
            w[p] = r.choice("abcd xyz")
        elif x < 0.7:
            del w[p]
        else:
            w.insert(p, r.choice("abc de"))
    return "".join(w)


def test_fuzzy_search_equals_dynamic_programming():
    r = random.Random(3)
    hits = 0
    for _ in range(600):
        notice, label = r.choice(license_scan.NOTICES)
        words = f"{' '.join(r.choice(['the', 'license', 'und mit']) for _ in range(r.randrange(4)))} {edited(r, notice)} {r.choice(['public', 'free', ''])}".split()
        want = least_edits(notice, words, license_scan.allowed(notice))
        found = license_scan.scan(" ".join(words))[2]
        assert min((m.edits for m, _ in found if (m.label, m.size) == (label, len(notice))), default=None) == want, (notice, words)
        hits += want is not None
    assert hits > 250


def test_every_place_and_its_span_in_the_source():
    text = "Röleased ünder the MIT  Licens.\nOr: mit (license)! CC-BY-NC 4.0"
    found = license_scan.scan(text)[2]
    assert [(m.label, m.edits, text[s:e]) for m, (s, e) in found] == [("mit", 1, "MIT  Licens"), ("mit", 0, "mit (license"), ("cc-by-nc", 0, "CC-BY-NC")]
    assert [(m.start, m.edits) for m in license_scan._search(license_scan.NOTICES).matches(" mit licens and x mit license the mit license mit lcense ")] == [(1, 1), (18, 0), (34, 0), (46, 1)]


def test_pieces_cover_the_notice():
    for notice, _ in license_scan.NOTICES:
        cut = license_scan.pieces(notice)
        assert "".join(p for _, p in cut) == notice and len(cut) == license_scan.allowed(notice) + 1 and min(len(p) for _, p in cut) >= 4


CLEAN = ["He will limit license fees and admit licensing costs.", "The general public enjoyed a free copy.", "Er kam mit Lizenz und mit Listen.", "A creative commons of ideas.", "apache helicopters landed", "She was granted free entry."]


def test_clean_sentences_get_no_label():
    assert [license_scan.scan(t)[2] for t in CLEAN] == [[]] * len(CLEAN)


def brute_op13(doc_id, text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in license_scan.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return doc_id, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_op13_base_equals_brute_force(spark):
    r = random.Random(9)
    parts = ["GNU General Public License", "apache-license", "CC BY 4.0", "cc by", "MIT\nLicense", "mit licence", "é", "the", "mit", "MIT license mit License", "İ", "Key", "x" * 500, "퟿"]
    data = [(k, r.choice([" ", "; ", "\n"]).join(r.choice(parts) for _ in range(r.randrange(12)))) for k in range(300)]
    data += [(400, None), (401, ""), (402, "..."), (403, "word " * 40_000 + "MIT License"), (404, "cc by cc by cc by"), (1, data[1][1]), (None, "MIT License")]
    table = spark.createDataFrame(data, TEXTS).withColumns({c: F.lit("x") for c in ("labels", "score", "n_words", "matches", "l__labels")})
    found = license_scan.op13(table.repartition(3)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=repr) == sorted((brute_op13(*x) for x in data), key=repr)
    for row in found:
        assert set(filter(None, row["base_labels"].split(","))) <= set(filter(None, row["labels"].split(",")))
        assert 0 <= row["score"] <= 1 and (row["score"] > 0) == bool(row["labels"]) and (not row["n_base"] or row["score"] == 1)
    assert license_scan.op13(table.limit(0)).collect() == []


def test_long_repetitive_texts_are_read_in_linear_time():
    text = "gnu general public " * 5000 + "gnu general public licence"
    assert [m.label for m, _ in license_scan.scan(text)[2]] == ["gpl"]
