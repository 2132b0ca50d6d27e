"""The training-data operators on small tables, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")

from lodestone.llm import bpe, chat, ctw, decontam, lines, quality, setsketch, shard, suffix, toxic  # noqa: E402

RNG = random.Random(3)
WORDS = [x + y for x in "bcdfgklmnp" for y in ("al", "em", "in", "or", "us", "at")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, other = prose(60), prose(40)
    near = base.split()
    near[30] = "changed"
    out = [base, base.upper(), " ".join(near), other, None, "", "  \n ", "one", "one two", prose(3000), "a" * 5000, other, base + "\n" + other, "é ü\n" + base[:80]]
    return [(i, t) for i, t in enumerate(out)] + [(0, base), (None, base)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, "en", "s", len(t or ""), 1.0, 2.0) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept double")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(t):
    return (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()


def shingles(t, k):
    w = words(t)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("percent,k", [(85, 3), (80, 5)])
def test_near_duplicates(docs, texts, percent, k):
    sets = [shingles(t, k) for _, t in texts]
    up = list(range(len(texts)))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                up[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(texts):
        ids.setdefault(find(i), []).append(d)
    wanted = sorted(repr((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None) if sets[i] else d)) for i, (d, _) in enumerate(texts))
    got = setsketch.near_duplicates(docs, percent, k).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = setsketch.keep_one(docs, percent, k).collect()
    groups = {find(i) for i in range(len(texts)) if sets[i]}
    assert len(kept) == len(groups) + sum(not s for s in sets) and kept[0].asDict().keys() == docs.first().asDict().keys()


def test_near_duplicates_of_a_large_family(spark, monkeypatch):
    """Blocks smaller than the family: links between blocks are found by the stragglers' queries."""
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    rng = random.Random(5)
    base = prose(80, rng).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 3) for _, t in rows]
    up = list(range(60))

    def find(x):
        return x if up[x] == x else find(up[x])

    for i in range(60):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85, 3).collect()}
    assert got == {i: find(i) for i in range(60)}


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 2000, dtype=np.uint64), rng.integers(0, 2**63, 2000, dtype=np.uint64)
    shared = np.concatenate([a[:1600], b])
    one = lambda *x: setsketch.registers(np.concatenate(x), np.array([0, sum(map(len, x))]))
    assert (np.maximum(one(a), one(b)) == one(a, b)).all()
    j = 1600 / (2000 + 3600 - 1600)
    assert abs(setsketch.likelihood_similarity(one(a), np.array([2000]), one(shared), np.array([3600]))[0] - j) < 0.15


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(5, "Alpha beta, gamma!"), (6, prose(30, random.Random(9))), (7, None), (8, " ,"), (5, "Alpha beta, gamma!"), (None, "alpha beta gamma")], "item_id long, text string")
    long = prose(30, random.Random(9)).split()
    rows = [(1, "x ALPHA  beta; Gamma y"), (2, "alphabeta gamma"), (3, None), (4, "q " + " ".join(long[4:16]) + " A r"), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in decontam.decontaminate(d, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (5, 3, ["5"]) and [(s.start, s.end) for s in got[1].spans] == [(2, 20)]
    assert got[2].n_hit == 0 and got[3].n_words == 0 and got[5].n_words == 0
    assert (got[4].n_words, got[4].n_hit, got[4]["items"]) == (15, 12, ["6"])
    assert {r.doc_id for r in decontam.drop_contaminated(d, items).collect()} == {2, 3, 5}
    assert decontam.decontaminate(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"item number {i} has words") for i in range(20)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"see item number {i} has words") for i in range(25)], "doc_id long, text string")
    monkeypatch.setattr(decontam, "MAX_BYTES", 60)
    assert {r.doc_id: r["items"] for r in decontam.decontaminate(d, items).collect()} == {i: [str(i)] if i < 20 else [] for i in range(25)}


def test_bpe(docs, texts):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.word_bpe_path())
    odd = ["aaaaaaaaaaaaa", "rrrrara anananan", "Don't WE'LL 12ab", "<|endoftext|>x<|startoftext|>", "ΑΣ İ ﬁ é", "日本 🎉🎊", "a\x1cb\x85c", "x" * 300]
    t = bpe.load(bpe.read_spec(bpe.word_bpe_path()))
    for x in odd + [t or "" for _, t in texts]:
        ids = ref.encode(x, add_special_tokens=False).ids
        assert t.encode(x) == ids and t.decode(ids) == ref.decode(ids, skip_special_tokens=False)
    got = bpe.token_digests(docs, bpe.word_bpe_path()).collect()
    wanted = sorted((str(d), len(i := ref.encode(x or "", add_special_tokens=False).ids), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, x in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in got) == wanted
    back = bpe.decode(bpe.encode(docs, bpe.word_bpe_path()), bpe.word_bpe_path())
    assert {"ids", "decoded"} <= set(back.columns) and back.count() == len(texts)


def test_automaton_of_few_merges():
    """All words of up to six letters over a small merge list, against merging by rank."""
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a</w>"), ("aa", "aa"), ("a", "b</w>"), ("ab", "ab</w>")]
    vocab = {}
    for s in bpe.byte_symbols():
        vocab.setdefault(s, len(vocab))
        vocab.setdefault(s + "</w>", len(vocab))
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    machine = bpe.TokenAutomaton(vocab, merges, "</w>")

    def by_rank(word):
        parts = list(word[:-1]) + [word[-1] + "</w>"]
        for a, b in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (a, b):
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    import itertools

    # The table: w may follow t if merging t and w by rank leaves them as they are.
    spelled = {t: i for t, i in vocab.items() if t in {"a", "b", "aa", "ab", "aab", "aaaa", "b</w>", "a</w>", "ba</w>", "ab</w>", "abab</w>"}}
    again = bpe.TokenAutomaton(vocab, merges, "</w>", machine.packed())
    assert (again.table == machine.table).all()

    def leaves(*tokens):
        flat = "".join(tokens)
        if not flat.endswith("</w>"):
            flat += "z</w>"
            return by_rank(flat[:-4])[:-1] == list(tokens)
        return by_rank(flat[:-4]) == list(tokens)

    for t in spelled:
        for x in spelled:
            if not t.endswith("</w>") and leaves(t):
                assert machine.arc(vocab[t], vocab[x]) == leaves(t, x), (t, x)
    for n in range(1, 8):
        for w in map("".join, itertools.product("ab", repeat=n)):
            assert [machine.label[i] for i in machine.encode_word(w.encode())] == by_rank(w), w


def test_two_stage_sorting():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.integers(97, 100, rng.integers(1, 60)).astype(np.uint8)
        order, raw = suffix.two_stage(s, 200), s.tobytes()
        assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))


def test_passages(docs, texts, nothing):
    key = lambda d: -(2**63) if d is None else d
    first = {}
    for d, t in texts:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, key(d)), key(d))
    wanted = []
    for d, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        wanted.append(repr((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())))
    got = suffix.dedup_passages(docs).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == sorted(wanted)
    assert suffix.dedup_passages(nothing).count() == 0


def removed_by_brute_force(rows):
    first, out = {}, []
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    for d, t in rows:
        b, gone = t.encode(), set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(b), len(gone), hashlib.sha256(bytes(x for i, x in enumerate(b) if i not in gone)).hexdigest()))
    return sorted(out)


def test_passages_of_nul_bytes_and_common_ones(spark, monkeypatch):
    """Runs of NUL, periodic text, and pieces with more occurrences than travel along with them."""
    rng = random.Random(41)
    shared, tail = prose(30, rng), prose(20, rng)
    rows = [(1, "abc" + "\0" * 60 + "def"), (2, "abc" + "\0" * 60 + "def"), (3, "\0" * 200), (4, "x" * 70 + "\0" * 40), (5, "ab" * 60), (6, "b" + "ab" * 70)]
    rows += [(10 + i, f"{prose(rng.randint(1, 9), rng)} {shared if i % 3 else tail} {prose(rng.randint(1, 9), rng)} {shared[: 40 + i]}") for i in range(40)]
    wanted = removed_by_brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for local in (64, 2):
        monkeypatch.setattr(suffix, "LOCAL", local)
        got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.dedup_passages(df).collect())
        assert got == wanted and got[1][2] == 66


def test_anchors_are_dealt_evenly(spark):
    """No bucket and no stretch of the bitmap gets several times its share, so a task holds about BUCKET_BYTES of text."""
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefghij ", k=40000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, text[::-1])], "doc long, text string")
    marked = np.unpackbits(suffix.shared_anchors(docs, 4)).reshape(16, -1).sum(1)
    assert marked.sum() > 1000 and marked.max() < 2 * marked.mean()


def test_passages_when_the_split_of_the_scan_changes(spark, tmp_path, monkeypatch):
    """Executors come and go: jobs over the same files may cut them differently."""
    rng = random.Random(31)
    shared = prose(25, rng)
    rows = [(i // 2 if i < 8 else i, f"{prose(rng.randint(1, 40), rng)} {shared if i % 3 else ''} {prose(rng.randint(1, 40), rng)}") for i in range(48)] + [(50, shared)] * 3
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    d = spark.read.parquet(path)
    key = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    result = lambda: sorted(tuple(r[k] for k in key) for r in suffix.dedup_passages(d).collect())
    wanted, write, name = result(), suffix.materialize, "spark.sql.files.maxPartitionBytes"
    assert len(wanted) == len(rows) and sum(w[2] > 0 for w in wanted) > 20
    before = spark.conf.get(name)

    def write_and_split(df):
        out = write(df)
        spark.conf.set(name, "1k")
        return out

    monkeypatch.setattr(suffix, "materialize", write_and_split)
    try:
        assert result() == wanted
    finally:
        spark.conf.set(name, before)


def distance_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def test_lines(spark, docs, nothing):
    rng = random.Random(11)
    pool = [prose(12, rng) for _ in range(6)]

    def edited(x):
        i = rng.randrange(len(x))
        return rng.choice([x[:i] + x[i + 1 :], x[:i] + "é" + x[i:], x[:i] + "Z" + x[i + 1 :], x, x[:i] + "YY" + x[i:]])

    rows = [(i, "\n".join([edited(rng.choice(pool)) for _ in range(rng.randint(0, 4))] + ["short", ""])) for i in range(40)] + [(40, None), (41, "")]
    seen, wanted = [], {}
    for d, t in rows:
        kept = []
        for x in (t or "").split("\n"):
            dup = bool(x) and any(x == y or (min(len(x), len(y)) >= 30 and distance_at_most_one(x, y)) for y in seen)
            if x:
                seen.append(x)
            if not dup:
                kept.append(x)
        wanted[d] = None if t is None else "\n".join(kept)
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == wanted
    assert lines.dedup_lines(nothing).count() == 0 and lines.dedup_lines(docs).count() == docs.count()


def test_lines_short_repeats(spark):
    """Exact repeats go at any length; short lines that differ, and blank lines, stay."""
    note = "All rights reserved."
    rows = [(1, f"{note}\n\nab\n \t"), (2, f"ab\n{note}\n\n \t"), (3, f"ac\n{note[:-1]}\n{note}\n{note}")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 4, 0), 2: ("\n \t", 4, 2), 3: (f"ac\n{note[:-1]}", 4, 2)}


def test_lines_of_several_edits(spark):
    """A replaced word or a few changed letters do not keep a long line; every pair is judged as by brute force."""
    rng = random.Random(23)
    pool = [prose(n, rng) for n in (7, 8, 12, 16, 17, 24, 25, 33, 41, 60, 90)]

    def edited(x):
        w = list(x)
        for _ in range(rng.randint(0, 7)):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["é", w[i]], ["Z"], [w[i], "Q"]])
        return "".join(w)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def repeats(a, b):
        n = min(len(a), len(b))
        return a == b or (n >= 30 and abs(len(a) - len(b)) <= 5 and distance(a, b) <= min(5, max(1, n // 32)))

    rows = [(i, "\n".join(edited(rng.choice(pool)) for _ in range(4))) for i in range(45)]
    rows.append((45, pool[9] + "\n" + pool[9].replace(pool[9].split()[5], "xyz", 1)))
    seen, wanted = [], {}
    for d, t in rows:
        kept = []
        for x in t.split("\n"):
            if not any(repeats(x, y) for y in seen):
                kept.append(x)
            seen.append(x)
        wanted[d] = "\n".join(kept)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted and 20 < sum(len(t.split("\n")) for t in wanted.values()) < 160


def test_sharding(docs, texts, nothing):
    n = 1000
    x = shard.permute(np.arange(n), n, 7)
    assert sorted(x) == list(range(n)) and (shard.permute(x, n, 7, inverse=True) == np.arange(n)).all() and list(x) != list(range(n))
    assert list(shard.permute(np.arange(1), 1, 7)) == [0]
    got = shard.shard(docs, 4).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts)
    assert shard.shard(nothing, 4).count() == 0


def test_toxicity(spark, docs, nothing):
    rng = random.Random(2)
    bad = ["vile", "grubby", "zorkish"]
    rows, marks = [], []
    for i in range(400):
        w = prose(40, rng).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "er", "est"]))
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxic.learn(d, spark.createDataFrame(marks + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxic.toxic_scores(d, model).collect()}
    unseen = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i].score >= 0.7) == (i % 4 == 0) for i in unseen) >= 0.97 * len(unseen)
    hit = next(i for i in unseen if i % 4 == 0 and got[i].spans)
    s = got[hit].spans[0]
    assert rows[hit][1][s.start : s.end].startswith(tuple(bad))
    assert all(0 <= r.score <= 1 for r in toxic.toxic_scores(docs, model).collect())
    assert toxic.toxic_scores(nothing, model).count() == 0
    assert toxic.drop_toxic(docs, model).columns == docs.columns
    empty = toxic.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score for r in toxic.toxic_scores(docs, empty).collect()} == {0.0}


def test_marginals_against_enumeration():
    import itertools

    f = toxic.Field({"x": 0}, {}, {}, np.array([2.0]), -1.0, np.array([[0.0, 0.3], [-0.2, 0.8]]))
    n, at, weights = 7, [1, 4], [2.0, 2.0]
    total, hot = 0.0, np.zeros(2)
    for tags in itertools.product((0, 1), repeat=n):
        s = sum(f.trans[a, b] for a, b in zip(tags, tags[1:])) + sum(t * (f.bias + (2.0 if i in at else 0.0)) for i, t in enumerate(tags))
        total += np.exp(s)
        hot += np.exp(s) * np.array([tags[i] for i in at])
    assert np.allclose(f.marginals(n, at, weights), hot / total)


def test_marginals_of_a_slowly_mixing_chain():
    """Whole documents are one chain: step by step gives the same as powers, however long the gap."""
    f = toxic.Field({"x": 0}, {}, {}, np.array([9.0]), -6.0, np.array([[0.0, -7.0], [-0.02, 5.9]]))
    n, at, weights = 400, [3, 350], [9.0, 9.0]
    matrix, up = np.exp(f.trans) * np.array([1.0, np.exp(f.bias)]), {3: np.exp(9.0), 350: np.exp(9.0)}
    forward, back = [np.array([1.0, np.exp(f.bias)])], [np.ones(2)]
    for i in range(1, n):
        a = forward[-1] @ matrix * np.array([1.0, up.get(i, 1.0)])
        forward.append(a / a.sum())
    for i in range(n - 1, 0, -1):
        b = matrix @ (np.array([1.0, up.get(i, 1.0)]) * back[-1])
        back.append(b / b.sum())
    both = np.array(forward) * np.array(back[::-1])
    assert np.allclose(f.marginals(n, at, weights), (both[:, 1] / both.sum(1))[at], rtol=1e-9)
    assert abs(f.background(n) - max(float(f.marginals(n, [i], [0.0])[0]) for i in range(n))) < 1e-12


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "a\nb", "", None, "<s>", "[\\INST]", "</s>\n<s>user\n"]
    rows = [(c, t, r, x) for c in (1, 2, None) for t, (r, x) in enumerate([("user", nasty[(t + (c or 0)) % 9]) for t in range(4)] + [("assistant", x) for x in nasty] + [("sys\ntem", "q"), (None, "z")])]
    rows += [(7, None, "assistant", "b"), (7, 1, "assistant", "a"), (7, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    whole = {r.conv_id: r for r in chat.format_chat(df).collect()}
    for c in (1, 2, None, 7):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars == len(whole[c].text)
        assert "".join(chat.unescape(whole[c].text[s.start : s.end]) for s in whole[c].mask) == loss
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_templates():
    render = chat.compile_template("{% for m in messages %}{% if m.role == 'user' and not (1 == 2) %}<{{ m.text | upper }}>{% elif m.role == 'x' %}X{% else %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endif %}{% endfor %}!")
    out = list(render([{"role": "user", "text": "a"}, {"role": "x", "text": ""}, {"role": "bot", "text": " b "}]))
    assert "".join(t for t, _ in out) == "<A>Xb!" and [t for t, g in out if g] == ["b"]
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% endif %}")) == (chat.Put(chat.Const("abc")),)
    for bad in ("{{ a.__class__ }}", "{{ open('x') }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | exec }}", "{{ 1 + }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_quality(docs, texts, nothing, spark):
    def counts(t):
        t = t or ""
        w = [x.decode() for x in t.encode().split()]
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        rep = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
        ls = [x for x in t.split("\n") if x.encode().split()]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(rep)

    extra = [(100, "a b c d e f g h " * 5), (101, "x\nx\n\n \nx\ty #|é"), (102, "p " * 30)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = quality.quality_rules(d).collect()
    wanted = sorted(repr((i, *counts(t), len(w := (t or "").encode().split()) < 20 or 100 * counts(t)[4] > 30 * len(w))) for i, t in texts + extra)
    assert sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in got) == wanted
    assert quality.quality_rules(nothing).count() == 0


def test_scores(spark, docs, texts, nothing):
    import math
    from collections import Counter

    got = ctw.ctw_scores(docs, ~ctw.held_out()).collect()
    train = Counter()
    for d, t in texts:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            train.update([*words(t), b"</end>"])
    n, v = sum(train.values()), len(train)
    wanted = sorted((str(d), len(w := [*words(t), b"</end>"]), sum(train[x] > 0 for x in w), round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for d, t in texts)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == wanted
    assert all(r.score < 0 and r.train_tokens == n for r in got)
    assert ctw.ctw_scores(nothing, ~ctw.held_out()).count() == 0


def test_scores_of_rare_keys_and_split_pairs(docs, monkeypatch):
    """Keys that are looked up in their buckets, and subtrees that are dealt by three bytes, score alike."""
    result = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in ctw.ctw_scores(docs, ~ctw.held_out()).collect())
    monkeypatch.setattr(ctw, "SPLIT", 0)
    wanted = result()
    monkeypatch.setattr(ctw, "SPLIT", 50)
    monkeypatch.setattr(ctw, "HOT", (16, 64))
    monkeypatch.setattr(ctw, "FINE_BYTES", 1 << 13)
    monkeypatch.setattr(ctw, "BUCKETS", 16)
    monkeypatch.setattr(ctw, "GATHER", 1000)
    assert result() == wanted


def test_scores_against_plain_context_trees(monkeypatch):
    """One subtree solver run on all grams equals a dictionary-based tree, and code lengths are a proper code."""
    data = [b"the cat sat", b"the hat", b"a cat", b"the the cat"]
    flat = b"".join(data)
    offsets = np.cumsum([0, *map(len, data)])
    (_, _), (key, _) = ctw.text_keys(flat, offsets)
    key, c = ctw._merged(key, np.ones(len(key), np.int64))
    code = ctw.Code(np.bincount((key & np.uint64(255)).astype(np.int64), c, 256))
    ids, zeros, ones, ln = ctw.solve(key, c, code, None)
    assert abs(sum(np.exp(-np.log(2) * code.length)) - 1) < 1e-9
    table = np.zeros((65536, 4))
    for i, a, b, x in zip(ids, zeros, ones, ln):
        table[i, :2] += a, b
        table[i, 3] += x
    table[:, 2] = ctw.kt_log(table[:, 0], table[:, 1])
    root = np.zeros((256, 4))
    root[:, :2] = table[:, :2].reshape(256, 256, 2).sum(0)
    root[:, 2] = ctw.kt_log(root[:, 0], root[:, 1])
    root[:, 3] = (np.logaddexp(table[:, 2], table[:, 3]) - np.log(2)).reshape(256, 256).sum(0)
    got = ctw.solve(key, c, code, (table, root))
    # the same mixture by recursion over a dictionary
    counts = {}
    for k, n in zip(key.tolist(), c.tolist()):
        ctx = [(k >> (8 * (ctw.DEPTH - d))) & 255 for d in range(ctw.DEPTH)]
        w, node, bit = code.decisions(np.array([k & 255]))
        for x, b in zip(node.tolist(), bit.tolist()):
            for d in range(ctw.DEPTH + 1):
                counts.setdefault((tuple(ctx[:d]), x), [0, 0])[b] += n

    def log_weighted(node):
        own = float(ctw.kt_log(np.array([float(counts[node][0])]), np.array([float(counts[node][1])]))[0])
        if len(node[0]) == ctw.DEPTH:
            return own, own, 0.0
        below = sum(log_weighted(m)[0] for m in counts if m[1] == node[1] and len(m[0]) == len(node[0]) + 1 and m[0][:-1] == node[0])
        return float(np.logaddexp(own, below) - np.log(2)), own, below

    for k, value in list(zip(key.tolist(), got))[:12]:
        ctx = [(k >> (8 * (ctw.DEPTH - d))) & 255 for d in range(ctw.DEPTH)]
        w, node, bit = code.decisions(np.array([k & 255]))
        total = 0.0
        for x, b in zip(node.tolist(), bit.tolist()):
            p = None
            for d in range(ctw.DEPTH, -1, -1):
                z = counts[(tuple(ctx[:d]), x)]
                k_est = (z[int(b)] + 0.5) / (sum(z) + 1)
                _, own, below = log_weighted((tuple(ctx[:d]), x))
                p = k_est if p is None else (lambda s: s * k_est + (1 - s) * p)(1 / (1 + np.exp(below - own)))
            total += np.log(p)
        assert abs(total - value) < 1e-9


def test_keys_against_plain_ones():
    """Token hashes and grams of odd texts, alone and side by side, and their counts."""
    from lodestone.llm.common import word_hashes

    odd = [b"", b" ", b"a", b"aB", b" a b\tc\n", b"x" * 4096 + b" y", b"x" * 4097 + b" y", "\u00e9 \u00fc b".encode(), b"a\0b \0", b"one two three " * 200]
    for data in [odd, odd[:5] + odd[7:], *([t] for t in odd)]:
        flat, offsets = b"".join(data), np.cumsum([0, *map(len, data)])
        (token, first), (gram, at) = ctw.text_keys(flat, offsets)
        hashes, starts = word_hashes(flat, offsets)
        assert token.tolist() == np.insert(hashes, starts[1:], ctw.END).tolist() and np.diff(first).tolist() == [len(t.split()) + 1 for t in data]
        wanted = []
        for t in data:
            whole = b" ".join([b"", *t.lower().split(), b"", b""]) if t.split() else b"  "
            wanted += [sum(whole[i - d] << 8 * (ctw.DEPTH + 1 - d) for d in range(1, min(i, ctw.DEPTH) + 1)) | whole[i] for i in range(1, len(whole))]
        assert gram.tolist() == wanted and at[-1] == len(wanted)
        train = np.arange(len(gram)) % 3 > 0
        plain = ctw._merged(gram, train.astype(np.int64), np.ones(len(gram), np.int64))
        assert [x.tolist() for x in ctw._counted(gram << np.uint64(1) | train.astype(np.uint8))] == [x.tolist() for x in plain]


def test_scores_hold_little_memory(monkeypatch):
    """A scan's arrays and those of lookups are small beside its lot and table, and a scan's worker gives memory back."""
    import tracemalloc

    import pyarrow as pa

    class Scan(list):
        select = groupBy = lambda self, *a: self

        def mapInArrow(self, f, schema):  # noqa: N802
            self.append(f)
            return self

        applyInArrow = mapInArrow  # noqa: N815

    def peak(f):
        tracemalloc.start()
        out = f()
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out, most

    monkeypatch.setattr(ctw, "LOT", 1 << 17, raising=False)  # 1 MB
    gone = []
    monkeypatch.setattr(ctw, "give_back", lambda: gone.append(1), raising=False)
    data = [prose(2000, random.Random(i)) for i in range(150)]
    batch = pa.record_batch([pa.array(data), pa.array([i % 5 > 0 for i in range(len(data))])], names=["text", "train"])
    deal = ctw.Deal(np.ones(65536, np.int64))
    scan, join = ctw.count_keys(Scan(), deal)
    rows, most = peak(lambda: [r for b in scan([batch]) for r in b.to_pylist()])
    assert most < 36 and gone
    n = {kind: sum(int(ctw.unplanes(r["n"], np.int64).sum()) for r in rows if r["kind"] == kind) for kind in (ctw.TOKEN, ctw.GRAM)}
    assert n == {ctw.TOKEN: 2001 * len(data), ctw.GRAM: sum(len(t) + 2 for t in data)}
    # a bucket whose runs come in 300 batches, 72 MB in all, is merged within little more than its distinct keys
    key, one = np.arange(10_000, dtype=np.uint64) * np.uint64(7), np.ones(10_000, np.int64)
    runs = (b for _ in range(300) for b in ctw._packed([(ctw.GRAM, 5, ctw._key_bytes(key), ctw.planes(one), ctw.planes(2 * one))], ctw._COUNTS))
    rows, most = peak(lambda: [r for b in join(runs) for r in b.to_pylist()])
    assert most < 40 and len(rows) == 1 and rows[0]["bucket"] == 5 and ctw._sorted_keys(rows[0]["key"]).tolist() == key.tolist()
    assert ctw.unplanes(rows[0]["c"], np.int64).tolist() == [300] * len(key) and ctw.unplanes(rows[0]["n"], np.int64).tolist() == [600] * len(key)
    table = ctw.Lookup(np.arange(1, 1 << 19, dtype=np.uint64), np.arange(1, 1 << 19) / 2)
    key = np.arange(1 << 20, dtype=np.uint64)
    got, most = peak(lambda: table.find(key))
    assert most < 20 and np.isnan(got[0]) and np.isnan(got[1 << 19 :]).all() and np.array_equal(got[1 : 1 << 19], key[1 : 1 << 19] / 2)


def test_lines_of_ascii_meet_others_and_are_cut_as_bytes(spark):
    from lodestone.llm import lines

    plain = "the quick brown fox jumps over the lazy dog, and then it sleeps"
    data = [(1, plain), (2, plain.replace("quick", "quïck")), (3, plain.replace("lazy", "lazé")), (4, "nothing like the lines before, at all, in any of its characters")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in lines.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}
    plan = lines._keyed(lines._lines(docs), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "length(tail" not in plan and "as binary" in plan


def test_line_keys_are_few_and_cover_shifts_either_way(spark):
    """12 keys a line for five edits, and none is missed whether a line's start or end is shifted back or forth."""
    assert [len(lines._places(t)) for t in range(1, 6)] == [2, 4, 6, 9, 12]
    line = prose(60, random.Random(5))
    n, pairs = len(line), []
    for a, b in [(2, 3), (3, 2), (5, 0), (0, 5), (1, 4)]:  # edits in the segments from the start and from the end
        cut, put = line, line
        for i in sorted([1 + 27 * i for i in range(a)] + [n - 2 - 27 * i for i in range(b)], reverse=True):
            cut, put = cut[:i] + cut[i + 1 :], put[:i] + "#" + put[i:]
        for other in (cut, put):
            pairs += [(line, other), (other, line), (line + "é", other + "é")]
    docs = [(2 * i + j, x) for i, pair in enumerate(pairs) for j, x in enumerate(pair)]
    found = lines._keyed(lines._lines(spark.createDataFrame(docs, "doc_id long, text string")), 5).where("place >= 0").collect()
    keys = [{r.key for r in found if r.dk == d} for d, _ in docs]
    assert n > 170 and all(len(x) == 12 for x in keys) and all(keys[2 * i] & keys[2 * i + 1] for i in range(len(pairs)))


def test_workers_drop_what_other_operators_keep(spark):
    """A worker that comes from a BPE stage does not hold its tokenizer beside the work of other stages."""

    class Frame:
        columns, schema, sparkSession = ["doc_id", "text"], None, spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    for run in (toxic.drop_toxic(Frame(), toxic.Field()), setsketch.sketch_documents(Frame(), 5)):
        bpe._loaded["spec"] = object()
        assert list(run(iter([]))) == [] and not bpe._loaded
