"""Secret scans against plain loops, and redaction."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noticeworks.llm import secrets
from noticeworks.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"
WORDS = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api"))
ASSIGN = re.compile(f"({WORDS.replace('[aA][pP][iI]', '[aA][pP][iI]_?[kK][eE][yY]')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def slow_base(t):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def slow_p(t):
    if re.fullmatch("[0-9]+", t):
        return 1.0
    bare = t.rstrip("=")
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", t):
        s, a = bare.lower(), secrets.HEXADECIMAL
    elif re.fullmatch("[A-Z2-7]+=*", t):
        s, a = bare, secrets.BASE32
    else:
        s, a = bare.replace("-", "+").replace("_", "/"), secrets.BASE64
    n, k, v = len(s), len(a), [a.index(c) + 1 for c in s]
    chi = k / n * sum(c * c for c in Counter(s).values()) - n
    free = k - 1
    uniform = ((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    up = [x > (k + 1) / 2 for x in v]
    high, low = sum(up), n - sum(up)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
    mean_runs = 2 * high * low / n + 1
    spread = math.sqrt(max(1e-9, (mean_runs - 1) * (mean_runs - 2) / (n - 1)))
    m = sum(v) / n
    serial = sum((x - m) * (y - m) for x, y in zip(v, v[1:], strict=False)) / max(1e-9, sum((x - m) ** 2 for x in v)) * math.sqrt(n)
    if not (uniform < 3.09 and abs((runs - mean_runs) / spread) < 3.29 and abs(serial) < 3.29):
        return 1.0
    shift = n * (k * secrets.COINCIDENCE[a] - 1)
    return 0.5 * math.erfc(-(chi - (free + shift)) / math.sqrt(2 * free + 4 * shift) / math.sqrt(2))


def slow_spans(texts):
    tokens = [[(m.start(), m.end(), min(300, math.floor(-math.log10(max(slow_p(m[0]), 1e-300)) / 0.1))) for m in re.finditer("[A-Za-z0-9+/_-]{20,}={0,2}", t)] for t in texts]
    bands = defaultdict(list)
    for row in tokens:
        for s, e, b in row:
            bands[math.floor(2 * math.log2(e - s))].append(b)
    out = []
    for t, row in zip(texts, tokens, strict=True):
        base = slow_base(t)
        new = []
        for s, e, b in row:
            all_ = bands[math.floor(2 * math.log2(e - s))]
            found = any(10 ** (-c * 0.1) <= 0.01 * sum(x >= c for x in all_) / len(all_) for c in set(all_) if c <= b)
            if found and not any(x < e and s < y for _, x, y in base):
                new.append(("random", s, e))
        out.append((base, sorted(base + new, key=lambda x: (x[1], secrets.KINDS.index(x[0])))))
    return out


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def expected(texts):
    for base, spans in slow_spans(texts):
        n = Counter(k for k, _, _ in base)
        yield n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def test_op7_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_secrets"](spark, DIR).collect()}
    assert got == dict(zip((r.doc_id for r in docs), expected([r.text or "" for r in docs]), strict=True))


def planted():
    rng = random.Random(7)
    letters = string.ascii_letters + string.digits + "+/"
    texts = ["", "é€😀 password = 'hunter2!' TOKEN:abc secret: token: abcdefgh", "api_key=a.b=c api-key=zzzzzz APIKEY: \"123456\" passwd=12345", "AKIA" + "A1" * 8 + " AKIAAKIAX AKIA" + "B" * 15]
    texts += ["0" * 23 + " " + "0" * 24 + "g" + "deadbeef" * 4, "secret=" * 50 + "x", "token=abcdef " * 300, "A" * 70_000]
    for _ in range(60):
        t = "".join(rng.choices(letters, k=rng.randrange(18, 70)))
        texts.append(f"ßomé word {t} and {'thereandbackagain' * rng.randrange(1, 4)} /path/to/some-page/of-the/site")
    return texts + [texts[-1]]


def test_planted_secrets_and_redaction(spark):
    texts = planted()
    rows = spark.createDataFrame([(None, 1, "x"), *((t, 1, "y") for t in texts)], "text string, N_hex int, spans string")
    out = secrets.shown(secrets.find_secrets(rows)).withColumn("clean", secrets.redacted(F.col("text"), F.col("secret_spans")))
    got = out.collect()
    assert sorted((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(expected(["", *texts]))
    assert sum("random" in r.spans for r in got) > 30
    spans = {t: s for t, (_, s) in zip(texts, slow_spans(["", *texts])[1:], strict=True)}
    for r in got:
        hidden, clean, at = "" if r.text is None else r.text, "", 0
        for s, e in merged(spans.get(r.text, [])):
            clean += hidden[at:s] + secrets.MASK
            at = e
        assert (r.clean or "") == clean + hidden[at:]
    assert secrets.find_secrets(rows.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet,lengths", [
    ("0123456789ABCDEF", (20, 28, 40, 64)), (string.ascii_letters + string.digits + "+/", (24, 32, 48, 96)), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (48, 64, 96)),
])
def test_recall_by_encoding_and_length(spark, alphabet, lengths):
    rng = random.Random(len(alphabet))
    words = [r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("text").limit(200).collect()]
    rows = []
    for n in lengths:
        for i in range(60):
            before = " ".join((words[(i * 7 + n) % 200] or "").split()[:40])
            rows.append((n, len(before) + 1, f"{before} {''.join(rng.choices(alphabet, k=n))} and more words"))
    found = secrets.find_secrets(spark.createDataFrame(rows, "n int, at int, text string")).collect()
    hits = Counter(r.n for r in found if any(s.start == r.at and s.end == r.at + r.n for s in r.secret_spans))
    assert all(hits[n] >= 0.9 * 60 for n in lengths), hits


def test_columns_of_the_caller_stay(spark):
    rows = spark.createDataFrame([("password=hunter22", 1, "a", 2, 3)], "text string, __assign int, hex string, row int, N_HEX int")
    out = secrets.find_secrets(rows)
    assert out.columns == ["text", "__assign", "hex", "row", "n_assign", "n_access", "n_hex", "base_spans", "secret_spans"]
    assert tuple(out.first())[:7] == ("password=hunter22", 1, "a", 2, 1, 0, 0)


def merged(spans):
    out = []
    for _, s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def test_prefixes(spark):
    arrays = [[], [4], list(range(50)), [0] * 7]
    rows = spark.createDataFrame([(a,) for a in arrays], "a array<int>")
    got = rows.select("a", secrets.prefixes(F.col("a"), F.lit(0), lambda x, y: x + y).alias("s")).collect()
    assert all(r.s == [sum(r.a[: i + 1]) for i in range(len(r.a))] for r in got)


def test_plan_is_native(spark):
    plan = QUERIES["op7_secrets"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
