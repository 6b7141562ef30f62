"""Secrets: fixed forms and random tokens against plain loops, and the odd rows of the docstring."""

import hashlib
import math
import random
import re
import string

import pytest

pytest.importorskip("parley.llm")
from pyspark.sql import functions as F  # noqa: E402

from parley.llm import secrets  # noqa: E402

SCHEMA = "doc_id long, text string, start string, kind int"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
PIECES = "ing the er ation mar vel tor lin gra sen det uth om ri qua pel ost wen Kar Lo".split()


def corpus(seed=2, n=300):
    """Prose with long glued words, paths and numbers; random tokens of several encodings; forms that just fail."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(PIECES) for _ in range(k))
    token = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    texts = []
    for _ in range(n):
        words = [word(rng.randrange(1, 4)) for _ in range(rng.randrange(30, 90))]
        for _ in range(rng.randrange(0, 3)):
            words.insert(rng.randrange(len(words)), word(12))
        for letters in (string.ascii_letters + string.digits, string.digits + "abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + "234567"):
            if rng.random() < 0.3:
                words.insert(rng.randrange(20, len(words)), token(letters, rng.choice([20, 22, 32, 33, 40, 64])) + rng.choice(["", "", "==", ",", "é"]))
        if rng.random() < 0.2:
            words.insert(rng.randrange(len(words)), rng.choice(["password: abc", "API_KEY='abcde.f'", "token=token=abcdef", 'secret=token"=abcdef', "Passwd  = " + token(string.digits, 8), "ſecret=abcdefg", "AKIA" + token(string.ascii_uppercase, rng.choice([15, 16, 20])), "apikey = " + token(string.ascii_letters, 30)]))
        texts.append(" ".join(words))
    texts += ["", None, "a\U0001f600 token=\U0001f600 password=abcdef \U0001f600" + "0123456789abcdef" * 2, "AKIA" * 9, "=" * 50, "- " * 30 + "-" * 40, texts[0], texts[0], "token=a " * 3000 + "password = longenough", "ab12" * 40000, "x" * 19 + " " + "y" * 21]
    rows = [(i * 2, t, "s", 1) for i, t in enumerate(texts)]
    return rows + [rows[4], (None, texts[3], None, None)]


def base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def encoding(body):
    for name, (letters, _) in secrets.ENCODINGS.items():
        if re.fullmatch(f"{letters}+", body) or name == "hex" and re.fullmatch("[0-9A-F]+", body):
            return name


def tail(z):
    z = min(8, max(-8, z))
    return -math.log(1 + math.exp(1.5976 * z + 0.07056 * z**3))


def score(body, alphabet):
    n, k, x = len(body), len(alphabet), [alphabet.index(c) for c in body]
    middle = (k - 1) / 2
    chi = sum(x.count(i) ** 2 for i in range(k)) * k / n - n
    turns = sum((a > middle) != (b > middle) for a, b in zip(x, x[1:]))
    serial = sum((a - middle) * (b - middle) for a, b in zip(x, x[1:]))
    two = lambda z: min(0, math.log(2) + tail(abs(z)))
    return -2 * (tail((chi - k + 1) / math.sqrt(2 * (k - 1) * (n - 1) / n)) + two((turns - (n - 1) / 2) / math.sqrt((n - 1) / 4)) + two(serial / ((k * k - 1) / 12 * math.sqrt(n - 1))))


def by_loops(rows, rate=0.05, least=20):
    """The method in plain loops: (doc_id, spans of the fixed kinds, all spans) and the number of random ones."""
    tokens, pools = [], {}
    for r, row in enumerate(rows):
        text, end = row[1] or "", 0
        found = list(re.finditer(f"[A-Za-z0-9+/_=-]{{{least},}}", text))
        for i, m in enumerate(found):
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None]
            body, reach = re.sub("=+$", "", m[0]), len(m[0]) * secrets.AROUND
            before, after, end = text[end : m.start()][-reach:], after[:reach], m.end()
            if len(body) < 2:
                continue
            kind = encoding(body)
            fold = {"hex": str.lower, "base36": str.lower, "base32": str.upper}.get(kind, str)
            body, before, after = fold(body), fold(before), fold(after)
            alphabet, n = secrets.ENCODINGS[kind][1], len(body)
            left, right = ("".join(c for c in t if c in alphabet) for t in (before, after))
            decoy = left[-n:] if len(left) >= n else (left + right)[:n] if len(left + right) >= n else None
            key = kind, max(c for c in secrets.CLASSES if c <= n)
            steps = [None if t is None else math.floor(score(t, alphabet) / secrets.STEP) for t in (body, decoy)]
            tokens.append((r, m.start(), m.end(), key, steps[0]))
            pools.setdefault(key, []).append(steps)
    limit = {}
    for key, pool in pools.items():
        t, d = sorted(a for a, _ in pool), sorted(b for _, b in pool if b is not None)
        for s in sorted({*t, *d}):
            if (sum(b <= s for b in d) + 1) * len(t) <= rate * sum(a <= s for a in t) * len(d):
                limit[key] = s
    out = []
    for r, row in enumerate(rows):
        fixed = base(row[1] or "")
        more = [(a, 3, b) for i, a, b, key, s in tokens if i == r and s <= limit.get(key, -1e9) and not any(x < b and a < y for x, _, y in fixed)]
        spell = lambda spans: ",".join(f"{['assign', 'access', 'hex', 'random'][k]}:{a}:{b}" for a, k, b in sorted(spans))
        out.append((row[0], *[sum(k == kind for _, k, _ in fixed) for kind in range(3)], hashlib.sha256(spell(fixed).encode()).hexdigest(), spell(fixed + more)))
    return sorted(out, key=str)


@pytest.mark.parametrize("rate, least", [(0.05, 20), (0.5, 12)])
def test_spans_equal_plain_loops(spark, rate, least):
    rows = corpus()
    got = secrets.scan_secrets(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), rate, least).collect()
    want = by_loops(rows, rate, least)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(w[-1].count("random") for w in want) > 100 and sum(w[1] + w[2] + w[3] for w in want) > 80


def test_random_tokens_are_found_and_glued_words_are_not(spark):
    rows = corpus(seed=9, n=600)
    found = {r.doc_id: r.spans for r in secrets.scan_secrets(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    hits = ordinary = tokens = 0
    for i, text, *_ in rows[:600]:
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[i].split(",") if s]
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            caught, glued = any(a < m.end() and m.start() < b for a, b in spans), re.fullmatch(f"({'|'.join(PIECES)})+", m[0])
            ordinary += bool(caught and glued)
            tokens += not glued
            hits += bool(caught and not glued)
    assert ordinary <= 0.05 * hits and hits >= 0.8 * tokens


def test_nothing_to_read(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.scan_secrets(spark, empty).collect() == []
    none = secrets.scan_secrets(spark, spark.createDataFrame([(1, None, "x", 2), (None, "", "x", 2)], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in none), key=str) == [(1, 0, 0, 0, ""), (None, 0, 0, 0, "")]


def test_no_python_runs(spark, capsys):
    df = secrets.scan_secrets(spark, spark.createDataFrame([(1, "token=abcdefgh")], "doc_id long, text string").select("doc_id", F.col("text")))
    df.explain("formatted")
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)


def test_the_sql_says_the_same(spark):
    import duckdb
    import pyarrow as pa

    from parley.llm.queries import ORACLES

    rows = corpus(seed=5)
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841  read by the SQL
    cursor = duckdb.connect().execute(ORACLES["op13_secrets"])
    names = [d[0] for d in cursor.description]
    got = secrets.scan_secrets(spark, spark.createDataFrame(rows, SCHEMA)).select(*names).collect()
    want = sorted(cursor.fetchall(), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want and sum("random" in w[names.index("spans")] for w in want) > 50
