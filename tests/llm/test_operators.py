"""Each operator against a brute-force version on a small table with every edge case."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import bpe, language, line_dedup, mixing, ngram_join, pii, queries, spotsigs, substring_dedup, token_counts, topk
from tidewatch.llm.automaton import SuffixAutomaton
from tidewatch.llm.components import components
from tidewatch.llm.runtime import Stash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def groups_of(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_ngram_join(docs, rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups_of(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(docs).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    assert len(set(want.values())) < len(want) - 10


def test_ngram_join_of_nothing(empty):
    assert ngram_join.groups(empty).collect() == []


def test_components(spark):
    links = [(i, i + 1) for i in range(40) if i % 13 != 12] + [(5, 5), (3, 2), (100, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Stash(spark, "t"), "c").collect()}
    nodes = {x for p in links for x in p if p[0] != p[1]}
    assert got == {n: r for n, r in groups_of(nodes, links).items()}


@pytest.fixture(scope="module")
def reference():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe(docs, rows, reference):
    want = {}
    for r in rows:
        ids = reference.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0]] = (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe.digests(docs, queries.vocabulary()).collect()} == want


def test_bpe_joins(reference):
    import random

    c, r = bpe.codec(queries.vocabulary()), random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("ab c'sñ日 \n\t12.é-") for _ in range(r.randrange(90)))
        assert c.encode(text, leaf=r.randrange(1, 25)) == reference.encode(text, add_special_tokens=False).ids


def test_bpe_round_trip(docs, empty):
    out = bpe.decode(bpe.encode(docs, queries.vocabulary()), queries.vocabulary())
    assert out.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0 and "key" in out.columns
    assert bpe.encode(empty, queries.vocabulary()).collect() == []


def test_token_counts(docs, rows, reference, empty):
    n = [len(reference.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    table = token_counts.limits(token_counts.histogram(docs, queries.vocabulary()))
    got = {r["n_tokens"]: r for r in table.collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r["n_docs"] == n.count(limit) and r["docs_within"] == sum(x <= limit for x in n) and r["docs_over"] == sum(x > limit for x in n)
        assert r["kept_tokens"] == sum(min(x, limit) for x in n) and r["lost_tokens"] == sum(n) - r["kept_tokens"] and r["total_tokens"] == sum(x for x in n if x <= limit)
        assert abs(r["quantile"] - r["docs_within"] / len(n)) < 1e-12
    assert token_counts.quantiles(table, [0.5]).first()[0] == sorted(n)[math.ceil(len(n) / 2) - 1]
    assert token_counts.limits(token_counts.histogram(empty, queries.vocabulary())).collect() == []


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return prev[-1]


def test_bit_parallel(spark):
    import random

    r, pairs = random.Random(7), []
    for _ in range(400):
        a = [r.choice("abé") for _ in range(r.randrange(0, 15))]
        b = list(a)
        for _ in range(r.randrange(0, 5)):
            b.insert(r.randrange(len(b) + 1), r.choice("abé")) if r.random() < 0.6 else b and b.pop(r.randrange(len(b)))
        if len(a) > 3 and len(b) > 3:
            pairs.append(("".join(a), "".join(b), distance(a, b)))
    df = spark.createDataFrame(pairs, "a string, b string, d int")
    for e in (1, 2, 3):
        assert df.where(line_dedup.bit_parallel(F.col("a"), F.col("b"), e) != (F.col("d") <= e)).count() == 0


def test_line_dedup(docs, rows, empty):
    placed = [(r[0], i, x) for r in sorted(rows) if r[1] is not None for i, x in enumerate(r[1].split("\n")) if x.strip()]
    first = {}
    for p in placed:
        first.setdefault(p[2], p[:2])
    near = {b for b in first for a in first if first[a] < first[b] and min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and len(a) < 300 and distance(a, b) <= 2}
    assert near
    want = {}
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for i, x in enumerate(lines) if not x.strip() or (x not in near and first[x] == (r[0], i))]
        want[r[0]] = (None if r[1] is None else "\n".join(keep), len(lines) - len(keep))
    got = line_dedup.dedup(docs)
    assert {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in got.collect()} == want
    assert line_dedup.dedup(empty).collect() == []


def test_mixing(docs, rows, empty):
    got = {r["doc_id"]: r for r in mixing.mix(docs, repeats=2.0).collect()}
    assert len(got) == len(rows)
    mass, real = Counter(), Counter()
    for r in rows:
        n = max(1, len(WORD.findall(r[1] or "")))
        assert got[r[0]]["n_tokens"] == n
        mass[r[3]] += n
        real[r[3]] += n * got[r[0]]["copies"]
    share = {s: m / sum(mass.values()) for s, m in mass.items()}
    alpha = max(0.0, 1 - math.log(2) / math.log(max(share.values()) / min(share.values())))
    p = {s: x**alpha for s, x in share.items()}
    budget = max(mass[s] / (p[s] / sum(p.values())) for s in p)
    longest = max(len(WORD.findall(r[1] or "")) for r in rows)
    for s in p:
        quota = budget * p[s] / sum(p.values())
        assert quota - longest - 1 <= real[s] <= quota + 1e-3 and real[s] >= mass[s]
    assert mixing.realise(mixing.mix(docs)).count() == sum(r["copies"] for r in got.values())
    assert mixing.mix(empty).collect() == []


def test_entropy_target(spark):
    s = spark.createDataFrame([(1000,), (100,), (10,)], "tokens long")
    a = mixing.exponent(s, 0.9, None)
    entropy = lambda a: -sum(w * math.log(w) for w in (x**a / sum(y**a for y in (1000, 100, 10)) for x in (1000, 100, 10)))
    assert entropy(a) >= 0.9 * math.log(3) - 1e-9 > entropy(a + 2**-20) - 1e-6


def test_substring_dedup(docs, rows, empty):
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    n = Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    want = {}
    for d, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if n[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        kept = " ".join(x for x, k in zip(w, keep, strict=True) if k)
        want[d] = (len(w), len(w) - sum(keep), kept)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.dedup(docs).collect()} == want
    assert sum(x[1] for x in want.values()) > 400
    assert substring_dedup.dedup(empty).collect() == []


def test_automaton():
    import random

    r = random.Random(2)
    for _ in range(200):
        seqs = [([r.choice("ab") for _ in range(r.randrange(3, 20))], r.choice([1, 1, 2])) for _ in range(3)]
        n = Counter()
        for s, w in seqs:
            for i in range(len(s) - 3):
                n[tuple(s[i : i + 4])] += w
        m = SuffixAutomaton(seqs)
        for s, _ in seqs:
            assert m.repeated(s, 4) == [i for i in range(len(s) - 3) if n[tuple(s[i : i + 4])] > 1]


def brute_spans(x):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    return sorted(out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 10 <= sum(c.isdigit() for c in m[0]) <= 15])


def test_pii(docs, rows, empty):
    import random

    r = random.Random(4)
    for _ in range(4000):
        x = "".join(r.choice("a@.b@-1 9+(") for _ in range(r.randrange(30)))
        assert pii.base_spans(x) == brute_spans(x)
    for x in ("10.0.0.0256 1.2.3.4", "1" * 4000 + ".1.1.1", "1" * 4000, "0001.002.3.4.5.6.7.8", "4111111111111111 4111 1111-1111 1111", "a@b.c@d.e"):
        assert pii.base_spans(x) == brute_spans(x)
    got = {q["doc_id"]: q for q in pii.find(docs, pii.train(docs)).collect()}
    for row in rows:
        want = brute_spans(row[1] or "")
        assert got[row[0]]["base"] == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert set(filter(None, got[row[0]]["base"].split(","))) <= set(got[row[0]]["spans"].split(","))
    assert pii.train(empty) == {} and pii.find(empty, {}).collect() == []
    assert pii.mask("mail a@b.c now", [(5, "email", 10)]) == "mail <email> now"


def test_reliabilities():
    rng, counts = np.random.default_rng(0), Counter()
    for _ in range(3000):
        y = rng.random() < 0.3
        votes = tuple(int(y if rng.random() < a else not y) if rng.random() < 0.9 else -1 for a in (0.95, 0.8, 0.7))
        counts[(1, *votes)] += 1
    prior, right = pii.reliabilities(counts)
    assert abs(prior[1] - 0.3) < 0.08 and right[1, 0].mean() > right[1, 1].mean() > 0.6
    assert (right[2] == right[0]).all() and abs(right[2] - 0.8).max() < 1e-9  # nothing is learnt about the other kinds


def test_spotsigs(docs, rows, empty):
    d = sorted(((r[0], r[1] or "") for r in rows), reverse=True)
    got = {r["doc_id"]: r for r in spotsigs.against_next(docs).collect()}
    prints = {}
    for i, (k, x) in enumerate(d):
        y = d[(i + 1) % len(d)][1]
        e = x[: len(x) - len(x) // 3] + y[: len(x) // 3]
        assert got[k]["n_chars"] == len(x) and got[k]["edited_sha256"] == sha(e) and 0 <= got[k]["near_edited"] <= 1
        a, b, c = (spotsigs.signatures(t) for t in (x, e, y))
        like = lambda p, q: 1.0 if p == q else len(p & q) / len(p | q)
        assert abs(got[k]["near_edited"] - like(a, b)) < 1e-9 and abs(got[k]["near_next"] - like(a, c)) < 1e-9
        assert prints.setdefault(x, got[k]["fingerprint"]) == got[k]["fingerprint"]
    assert spotsigs.against_next(empty).collect() == []


def test_spotsigs_join(docs, rows):
    prints = {spotsigs.fingerprint(r[1]) for r in rows if r[1]}
    want = {tuple(sorted((hashlib.md5(a.encode()).hexdigest(), hashlib.md5(b.encode()).hexdigest()))) for a in prints for b in prints if a < b and spotsigs.likeness(a, b) >= 0.5}
    got = spotsigs.similar(docs, 0.5).collect()
    assert {(r["a"], r["b"]) for r in got} == want and want


def test_language(spark, sf, docs, empty):
    d = queries.documents(spark, sf)
    got = queries.op9_language(spark, sf).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9 and got["score"].between(0, 1).all()
    model = language.fit(docs, per_lang=20)
    out = language.predict(docs, model).collect()
    assert all((r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", r["text"] or "")) for r in out)
    assert language.predict(docs, language.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language.predict(empty, model).collect() == []


def test_topk(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 0.3, (130, 6)), 1)
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(130)] + [(200 + i, [0.5] * 6, 1) for i in range(30)]
    rows += [(400, None, 1), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (440, [float("nan")] * 6, 1), (460, [float("inf")] * 6, 1), (480, [], 1), (500, [1.0, 2.0], 1), (520, [3.0, -1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ok = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()}
    want = set()
    for q in ok:
        if q % 20 == 0:
            best = sorted((-int(ok[q] @ ok[c]), c) for c in ok if c != q and len(ok[c]) == len(ok[q]))[:20]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in topk.search(df, F.col("vec_id") % 20 == 0).collect()} == want
    assert topk.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
