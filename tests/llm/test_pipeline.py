"""The pipeline over the smallest tables and over small ones with nulls, repeats and clashing names: each stage's decisions against brute force on its own input."""

import hashlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm import bpe, decontam, toxic  # noqa: E402
from lodestone.llm.common import materialize  # noqa: E402

DATA = "/root/testdata/sf0.001"
#: Columns that operators use inside, or add.
CLASHING = ["id", "th", "dk", "row", "kept", "own", "n_lines", "n_dropped", "n_words", "score", "key", "pos", "bucket"]


def distance(a, b, most):
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j in range(max(1, i - most - 1), min(len(b), i + most + 1) + 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != b[j - 1]))
        if i + most + 2 <= len(b):
            row[i + most + 2] = most + 9
    return row[-1]


def repeats(a, b):
    n = min(len(a), len(b))
    if a == b or n < 30:
        return a == b
    most = min(5, max(1, n // 32))
    if abs(len(a) - len(b)) > most or sum(abs(a.count(c) - b.count(c)) for c in set(a) | set(b)) > 2 * most:
        return False
    return distance(a, b, most) <= most


def blank(x):
    return not x.strip(" \t\n\x0b\x0c\r")


def by_lines(rows):
    """(index, text) of what line dedup leaves, in the order of doc_id; rows: (doc_id, text)."""
    seen, known, out = [], set(), {}
    for i, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0)):
        if t is None:
            out[i] = t
            continue
        kept, gone = [], 0
        for x in t.split("\n"):
            if blank(x):
                kept.append(x)
                continue
            if x in known or any(repeats(x, y) for y in seen if abs(len(x) - len(y)) <= 5):
                gone += 1
            else:
                kept.append(x)
            if x not in known:
                known.add(x)
                seen.append(x)
        text = "\n".join(kept)
        if not gone or not blank(text):
            out[i] = text
    return out


def shingles(t):
    w = (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def by_copies(rows):
    """Documents that near-dedup keeps: one of each group, and all without words."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i, (d, _) in enumerate(rows):
        if sets[i]:
            best.setdefault(find(i), []).append((d is None, d or 0))
    return sorted(min(x)[1] if not min(x)[0] else None for x in best.values()), sum(not s for s in sets)


def test_run_against_brute_force(spark):
    """run() over whole tables: every stage worked out plainly, from the fitted field on."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    field = toxic.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(d, t) for d, t in rows if field.score(t or "", False)[0] < toxic.THRESHOLD]
    left = by_lines(rows)
    rows = [(rows[i][0], t) for i, t in sorted(left.items())]
    ids, _ = by_copies(rows)
    rows = [(d, t) for d, t in rows if d in set(ids) or not shingles(t)]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = set()
    for _, t in items:
        w = decontam.words_of(t or "")
        size = min(10, len(w))
        windows |= {tuple(w[i : i + size]) for i in range(len(w) - size + 1 if size else 0)}
    sizes = {len(w) for w in windows}
    hit = lambda t: any(tuple(w[i : i + n]) in windows for w in [decontam.words_of(t or "")] for n in sizes for i in range(len(w) - n + 1))
    rows = [(d, t) for d, t in rows if not hit(t)]
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.word_bpe_path())
    wanted = sorted((d, len(e := ref.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(ref.decode(e, skip_special_tokens=False).encode()).hexdigest()) for d, t in rows)
    got = pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == wanted and len(wanted) > 50


@pytest.fixture(scope="module")
def odd(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while birds sing softly above green fields"
    texts = [base, base, base.replace("lazy", "tired"), None, "", "  \n ", "one", base + "\nalpha beta gamma", "alpha beta gamma", "word " * 30000, base]
    rows = [(i if i != 7 else None, t, None, "s", None, *(f"{c}{i}" for c in CLASHING)) for i, t in enumerate(texts)] + [(0, base, None, "s", 5, *(f"{c}x" for c in CLASHING))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.mark.parametrize("at", range(4))
def test_stages_with_nulls_repeats_and_clashing_names(spark, odd, at):
    name, stage = pipeline.STAGES[at]
    before = [tuple(r) for r in odd.collect()]
    out = stage(spark, odd, DATA)
    assert out.columns == odd.columns, name
    after = [tuple(r) for r in out.collect()]
    untouched = {(*r[:1], *r[2:4], *r[5:]) for r in before}
    assert {(*r[:1], *r[2:4], *r[5:]) for r in after} <= untouched  # all but text and n_chars
    texts = [(r[0], r[1]) for r in after]
    if name == "line dedup":
        left = by_lines([(r[0], r[1]) for r in before])
        assert sorted(texts, key=repr) == sorted(((before[i][0], t) for i, t in left.items()), key=repr) and 4 < len(left) < len(before)
    elif name == "MinHash near-dedup":
        ids, wordless = by_copies([(r[0], r[1]) for r in before])
        assert sorted(((d is None), d or 0) for d, t in texts if shingles(t)) == sorted(((d is None), d or 0) for d in ids)
        assert sum(not shingles(t) for _, t in texts) == wordless
    elif name == "benchmark decontamination":
        assert len(after) == len(before)
    assert stage(spark, odd.limit(0), DATA).count() == 0


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, DATA))
        assert out.columns == columns, name
        assert 0 < out.count() <= count
        docs, count = out, out.count()
