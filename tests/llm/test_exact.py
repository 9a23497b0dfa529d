"""Operators against brute force and exact round trips."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import decontaminate, line_dedup, near_dedup, packing, quality_rules, tokens, wavelet
from chainloom.llm.common import hash_text, table
from chainloom.llm.queries import tokenizer

SF = "/root/testdata/sf0.01"
ODD = ["", "  a  b\n\n c\t\td  x ", "it's 'S can't\x1cfoo　bar", "Ⅷ ½ ÀÉß×÷ ΣΑΣ İstanbul é <|endoftext|> x<|startoftext|>y", "word.\nNext&&& the*** it's, (x) don't. a_b", "a" * 3000 + " 🙂 ñ\r\n\r\n 12345 don't!!'s", "\n\n\n x\n", "trail \n", "ªµº ²³¼ \x85x\xa0y"]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, part string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_exact(spark, name):
    encode = tokens.load_encoder(tokenizer(name))
    texts = ODD + [r["text"] for r in table(spark, SF, "documents").orderBy("doc_id").limit(300).collect()]
    want = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == want and encode(texts) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_forgets_only_what_is_not_met_again(name, monkeypatch):
    """Few pieces are held, those of every text are learned once, and the ids stay those of the library."""
    encode, learned = tokens.load_encoder.__wrapped__(tokenizer(name)), []
    for place in ("most", "MAX_PIECES"):
        monkeypatch.setattr(tokens.Encoder if place == "most" else tokens, place, 100, raising=False)
    monkeypatch.setattr(type(encode), "most", 100, raising=False)
    learn = encode.learn
    encode.learn = lambda missing: (learned.extend(missing), learn(missing))
    letters = "abcdefghijklmnopqrst"
    for a in letters:
        text = " ".join(["the ever same, words", *(f"{a}{b}{c}x" for b in letters for c in "aeiou"), "ÀÉß don't", f"so\n{a}{a}. x1y!"])
        assert encode([text, ""]) == [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in (text, "")]
    assert sum(p.strip() == "ever" for p in learned) == 1
    assert len(encode.pieces) + len(encode.older) < 500


@pytest.mark.parametrize("name, before", [("byte_bpe_50k.json", " "), ("byte_bpe_50k.json", ""), ("word_bpe_49k.json", "")])
def test_merges_of_many_words_at_once(name, before):
    """Words of every length and of repeated letters get the library's ids, without the library's help."""
    encode, draw = tokens.load_encoder.__wrapped__(tokenizer(name)), random.Random(5)
    words = ["a" * k for k in range(1, 31)] + ["anan" * k for k in range(1, 8)] + ["é" * k for k in range(1, 31)] + ["thing", "nothingness"]
    words += ["".join(draw.choice("eeettaaoinshrdluéÿ") for _ in range(draw.randint(1, 30))) for _ in range(6000)]
    want = [encode.direct(before + w) for w in words]
    assert encode.merges.encode(words, before) == want
    encode.tokenizer = None  # the encoder itself doesn't ask it either
    encode([f"so {' '.join(words)}"])
    assert before == "" and name[0] == "b" or [encode.pieces[w] for w in words] == want


def test_plain_words_and_single_marks_need_no_pattern(monkeypatch):
    """The commonest pieces are told apart without the pattern, the others among them still by it."""
    encode, asked = tokens.load_encoder.__wrapped__(tokenizer("byte_bpe_50k.json")), []

    class Asked:
        fullmatch = lambda key, match=encode.WORD.fullmatch: (asked.append(key), match(key))[1]

    monkeypatch.setattr(type(encode), "WORD", Asked)
    for text in ("so plain words, and üßé. marks! here? yes; no: all", f"odd ªµº, Ωmega, 日本. {'a' * 31}, {'é' * 30}, {'b' * 31} a,b x). don't, 12, ,, . end"):
        assert encode([text, text]) == [encode.direct(text)] * 2
    assert {"so\n\n", "a,b", "x).", "don't,", "ªµº,"} <= set(asked) and not {"plain", "words,", "üßé.", "marks!", "all"} & set(asked)


def test_units_of_token_files_need_no_library(monkeypatch):
    """Short units of the vocabulary's pattern are merged here; only longer ones and other scripts are asked for one by one."""
    encode, asked = tokens.load_encoder.__wrapped__(tokenizer("word_bpe_49k.json")), []
    direct = encode.direct
    text = f"The cat's 12 ÀÉß ***, {'a' * 30} {'é' * 31} İ"
    monkeypatch.setattr(encode, "direct", lambda t: (asked.append(t), direct(t))[1])
    monkeypatch.setattr(encode, "plain", None, raising=False)
    assert encode([text[:-1], text]) == [direct(text[:-1]), direct(text)]
    assert encode(["日本 USA ПРИВЕТ 'S ×÷"]) == [direct("日本 USA ПРИВЕТ 'S ×÷")]  # pieces without a small Latin letter are lower-cased too
    assert "é" * 31 in asked and not {"the", "cat", "'s", "1", "àéß", "***,", "a" * 30} & set(asked)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 0), (5, 1), (513, 3), (5000, 49_407), (2000, 70_000)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top + 1, n).astype(np.uint32)
    file = wavelet.to_file(ids, [7, 9], [n // 2, n - n // 2])
    m, names, lengths = wavelet.from_file(file)
    assert (m.decode() == ids).all() and names.tolist() == [7, 9] and lengths.sum() == n
    draw = random.Random(n)
    for _ in range(40 if n else 0):
        i = draw.randrange(n)
        s = int(ids[i])
        assert m.access(i) == s and m.count(s) == (ids == s).sum() and m.rank(s, i) == (ids[:i] == s).sum() and m.select(s, m.rank(s, i)) == i
    assert m.count(top + 1000) == 0


def test_planes_are_made_and_undone_by_places():
    """Planes and ids as from plain code with masks, which takes longer to undo them."""
    from time import process_time

    ids, spent = np.random.default_rng(3).integers(0, 50_000, (1 << 19) - 77).astype(np.uint32), ([], [])
    m, left = wavelet.WaveletMatrix.build(ids), ids
    for shift, (zeros, ranks, packed) in zip(range(15, -1, -1), m.planes):
        bit = (left >> np.uint32(shift) & 1).astype(bool)
        seen = np.concatenate([[0], np.cumsum(np.append(bit, [False] * 77).reshape(-1, 512).sum(1))])
        assert zeros == (~bit).sum() and (ranks == seen).all() and (packed == np.packbits(bit, bitorder="little")).all()
        left = np.concatenate([left[~bit], left[bit]])

    def masks():
        out = np.zeros(m.n, np.uint16)
        for level, (zeros, _, packed) in enumerate(reversed(m.planes)):
            bit, before = np.unpackbits(packed, count=m.n, bitorder="little").view(bool), np.empty(m.n, np.uint16)
            before[~bit], before[bit] = out[:zeros], out[zeros:] | np.uint16(1 << level)
            out = before
        return out

    for _ in range(7):
        for way, times in zip((m.decode, masks), spent):
            began = process_time()
            assert (way() == ids).all()
            times.append(process_time() - began)
    assert min(spent[0]) < 0.85 * min(spent[1])


def test_token_files(spark):
    docs = docs_of(spark, [*ODD, None]).union(docs_of(spark, ["again"]))
    rows = wavelet.encode_to_files(docs, tokenizer("word_bpe_49k.json")).orderBy("start").collect()
    encode = tokens.load_encoder(tokenizer("word_bpe_49k.json"))
    at, texts = 0, sorted([(i, t or "") for i, t in enumerate([*ODD, None])] + [(0, "again")])
    assert [r["doc_id"] for r in rows] == [i for i, _ in texts]
    for r, (_, t) in zip(rows, texts):
        ids = encode([t])[0] + np.array([2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    assert wavelet.encode_to_files(docs.where("false"), tokenizer("word_bpe_49k.json")).count() == 0


def test_token_files_answer_questions(spark, tmp_path):
    """Access, count and occurrences through written files of several shards, against the plain sequence."""
    draw = random.Random(3)
    docs = docs_of(spark, [" ".join(draw.choice("the cat sat on a mat and 12 don't".split()) for _ in range(draw.randint(0, 60))) for _ in range(60)] + ["long " * 3000])
    path = str(tmp_path / "shards")
    wavelet.write_shards(docs, tokenizer("word_bpe_49k.json"), path, shard_tokens=300)
    encode = tokens.load_encoder(tokenizer("word_bpe_49k.json"))
    ids = np.concatenate([np.append(np.frombuffer(encode([r["text"]])[0], "<u4"), 2) for r in docs.orderBy("doc_id").collect()])
    assert spark.read.parquet(path).count() > 5
    asked = [0, 1, 17, len(ids) - 1, len(ids), *draw.sample(range(len(ids)), 50)]
    got = {r["position"]: r["token"] for r in wavelet.tokens_at(spark, path, spark.createDataFrame([(p,) for p in asked], "position long")).collect()}
    assert got == {p: int(ids[p]) for p in asked if p < len(ids)}
    some = [2, int(ids[0]), int(ids[5]), 48_000]
    assert {r["token"]: r["n"] for r in wavelet.count_tokens(spark, path, some).collect()} == {t: int((ids == t).sum()) for t in some}
    assert sorted(r["position"] for r in wavelet.occurrences(spark, path, some[2]).collect()) == np.flatnonzero(ids == some[2]).tolist()


def test_packing_of_long_texts_and_clashing_columns(spark):
    rows = [(1, "word " * 30_000, 5, "x"), (1, "word " * 30_000, 5, "x"), (None, "", 6, "y"), (3, None, 7, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, sequence_id string")
    out = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    n = len(tokens.load_encoder(tokenizer("byte_bpe_50k.json"))(["word " * 30_000])[0]) // 4 + 1
    mine = sorted((r["start"], r["length"]) for r in out if r["doc_id"] == 1)
    assert mine == sorted(packing.cut_points(n, 1024) * 2) and sum(r["length"] for r in out) == 2 * n + 2
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)


def test_rules_on_long_texts_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c " * 40_000, 1, 2), (2, "ä" * 300_000, 1, 2), (2, "ä" * 300_000, 1, 2)], "doc_id long, text string, n_words int, h int")
    rows = quality_rules.rule_statistics(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in rows) == [(1, 120_000, 120_000, 120_000), (2, 1, 300_000, 0), (2, 1, 300_000, 0)]


def test_packing(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").union(docs_of(spark, [None, ""]).select("doc_id", "text"))
    rows = packing.pack(docs, tokenizer("byte_bpe_50k.json")).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for seq in by.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(by) <= total / 1024 * 1.01 + 1
    encode = tokens.load_encoder(tokenizer("byte_bpe_50k.json"))
    for text, r in [(d["text"], [x for x in rows if x["doc_id"] == d["doc_id"]]) for d in docs.where("doc_id BETWEEN 5 AND 40").collect()]:
        ids = encode([text])[0] + np.array([2], "<u4").tobytes()
        r.sort(key=lambda x: x["piece"])
        assert [x["start"] for x in r] == [s for s, _ in packing.cut_points(len(ids) // 4, 1024)]
        assert all(zlib.crc32(ids[4 * x["start"] : 4 * (x["start"] + x["length"])]) == x["ids_crc32"] for x in r)
        assert all(x["length"] == 1024 for x in r[1:])
    assert packing.pack(docs.where("false"), tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_plan_keeps_every_capacity(rule):
    draw = random.Random(3)
    histogram = {n: draw.randrange(1, 60) for n in range(3, 100, 4)}
    plan = packing.plan_bins(histogram, (100, 4, 5000.0 + 100**2), rule=rule)
    bins = {}
    for length, (first, sequence, offset) in plan.places.items():
        ends = [*first[1:], histogram[length]]
        for f, s, o, e in zip(first, sequence, offset, ends):
            for k in range(e - f):
                bins.setdefault(s + k, []).append((o, length))
    assert sum(len(b) for b in bins.values()) == sum(histogram.values()) and len(bins) == plan.sequences
    for b in bins.values():
        assert sum(n for _, n in b) <= 100 and len(b) <= 4 and len({o for o, _ in b}) == len(b)
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, (100, 4, 1e9))


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def mutated(draw, line, most):
    c = list(line)
    for _ in range(draw.randint(0, most)):
        i, o = draw.randrange(len(c)) if c else 0, draw.random()
        if o < 0.4 and c:
            c[i] = draw.choice("abcdef")
        elif o < 0.7 or not c:
            c.insert(i, draw.choice("xyz"))
        else:
            del c[i]
    return "".join(c)


def test_band_automaton(spark):
    draw = random.Random(1)
    rows = [("".join(draw.choice("ab") for _ in range(draw.randint(1, 12))), "".join(draw.choice("ab") for _ in range(draw.randint(1, 12)))) for _ in range(800)]
    rows += [(a, mutated(draw, a, 3) or "a") for a, _ in rows]
    df = spark.createDataFrame(rows, "a string, b string")
    for k in (1, 2, 3):
        assert df.where(line_dedup.within_edits("a", "b", k) != (F.levenshtein("a", "b") <= k)).count() == 0


@pytest.mark.parametrize("edits, hot, few", [(1, 50, 250_000), (1, 3, 0), (2, 3, 0)])
def test_line_dedup(spark, monkeypatch, edits, hot, few):
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    monkeypatch.setattr(line_dedup, "COPIES", 3)
    draw = random.Random(edits * 10 + hot)
    base = ["alpha beta gamma delta", "one two three four five", "lorem ipsum dolor sit amet x", "  Alpha Beta Gamma Delta\t"]
    docs = [(i, "\n".join(mutated(draw, draw.choice(base), 3) if draw.random() < 0.9 else "short" for _ in range(draw.randint(0, 6))), "k") for i in range(80)] + [(200, None, "k"), (201, "", None), (202, "x" * 50_000, "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, line string")
    got = line_dedup.dedup_lines(df, edits, 20, hot)
    assert got.columns == ["doc_id", "text", "line", "n_exact", "n_near"]
    assert {r["doc_id"]: r["text"] or "" for r in got.collect()} == lines_left(docs, edits)
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def lines_left(docs, edits, min_chars=20):
    out, firsts, met = {}, [], set()
    for i, t, *_ in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        kept = []
        for line in (t or "").split("\n"):
            n = line.strip(" \t\r").lower()
            if n and n not in met:
                met.add(n)
                if len(n) < min_chars:
                    kept.append(line)
                else:
                    if not any(abs(len(n) - len(f)) <= edits and distance(n, f) <= edits for f in firsts if len(f) < 1000):
                        kept.append(line)
                    firsts.append(n)
            elif not n:
                kept.append(line)
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_keys_are_made_once(spark, edits):
    """A line's index keys serve its search too, so they aren't made or written again; the others hold all that is left."""
    line = spark.createDataFrame([("a line of some thirty characters", 32, 0)], "line string, n int, salt long")
    keys = lambda made: [k for k in line.selectExpr(f"array({', '.join(made)})").first()[0]]
    own, every, rest = keys(line_dedup.index_keys(edits)), keys(line_dedup.probe_keys(edits)), keys(line_dedup.probe_keys(edits, own=False))
    assert set(own) < set(every) and sorted(own + rest) == sorted(every)


def test_short_lines_go_if_equal(spark):
    docs = [(1, "}\n\nyes"), (2, "} \n\nno\nYES"), (None, "no"), (3, "yet\nno\n}")]
    got = {r["doc_id"]: (r["text"], r["n_exact"], r["n_near"]) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: ("}\n\nyes", 0, 0), 2: ("", 3, 0), None: ("no", 0, 0), 3: ("yet", 2, 0)}


def test_line_dedup_keeps_other_columns(spark):
    """Columns with the names that the operator uses itself, rows that share an id, ties."""
    line = "a line that is said in every document"
    rows = [(1, line, 5, 7, 9, 11, 13), (2, f"{line}\nown words of the second one", 5, 7, 9, 11, 13), (2, f"other\n{line}", 5, 7, 9, 11, 13), (2, f"{line}\nown words of the second one", 5, 7, 9, 11, 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc long, __lines long, __gone long, N_Exact long, __made long")
    out = line_dedup.dedup_lines(df, counts=False)
    assert out.columns == df.columns
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([(1, line, 5, 7, 9, 11, 13), (2, "own words of the second one", 5, 7, 9, 11, 13), (2, "other", 5, 7, 9, 11, 13), (2, "own words of the second one", 5, 7, 9, 11, 13)])
    counted = line_dedup.dedup_lines(df)
    assert counted.columns == ["doc_id", "text", "__doc", "__lines", "__gone", "__made", "n_exact", "n_near"]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [1]  # one text of 2 holds 4 of 5 shingles of 1


def test_line_dedup_of_a_long_text(spark):
    """A text of 60 000 lines of which half go; work must not grow with lines times removed lines."""
    text = "\n".join(f"line number {i // 2} of a very long text" for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = line_dedup.without(df, line_dedup.exact_repeats(df, scratch := []), "n", scratch).collect()
    assert row["n"] == 30_000 and row["text"] == "\n".join(f"line number {i} of a very long text" for i in range(30_000))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts, percent):
    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent, block", [(85, 96), (85, 8), (80, 8)])
def test_near_duplicates(spark, percent, block):
    draw = random.Random(percent + block)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(6):
        base = [draw.choice(vocabulary) for _ in range(draw.choice((3, 8, 60, 150)))]
        for _ in range(draw.choice((2, 10, 40))):
            w = list(base)
            for _ in range(draw.randint(0, 4)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    texts |= {1000: None, 1001: "", 1002: "one", 1003: "ONE", 1004: " \t\n", 1005: "É x", 1006: "é x"}
    df = spark.createDataFrame([(i, t, "b") for i, t in texts.items()], "doc_id long, text string, bands string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, percent, block).collect()}
    assert got == brute_components(texts, percent)
    kept = near_dedup.keep_one(df, percent)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in brute_components(texts, percent).values()}


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x " * 30_000)], "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    assert len(rows) == 4 and {(r["doc_id"], r["component_id"]) for r in rows} == {(None, None), (3, None), (4, 4)}
    assert near_dedup.near_duplicates(df.where("false")).count() == 0


def test_words_of_equal_crc_are_not_equal(spark):
    """Pairs that collide in CRC-32 stay apart, as words and as documents."""
    assert hash_text("plumless") != hash_text("buckeroo")
    df = spark.createDataFrame([(1, "plumless one two three four"), (2, "buckeroo one two three four")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()} == {(1, 1, True), (2, 2, True)}


def test_near_duplicates_in_bands_without_a_link_to_the_center(spark):
    """Families whose members are linked with some of each other only, so stars settle little and blocks must find the rest."""
    draw = random.Random(9)
    vocabulary, texts = [f"v{i}" for i in range(3000)], {}
    for _ in range(4):
        base = [draw.choice(vocabulary) for _ in range(120)]
        for _ in range(60):
            w = list(base)
            for _ in range(draw.randint(1, 5)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (near_dedup.BLOCK, 16):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 85, block).collect()}
        assert got == brute_components(texts, 85)
    assert len({c for _, c in got.values()}) > 8


def test_near_duplicates_linked_by_blocks_only(spark):
    """Two texts whose every shared band has a third one as its center, with which neither is linked: stars find no link at all."""
    common = " ".join(f"c100x{i}" for i in range(89))
    texts = {i: f"{common} " + " ".join(f"{x}100x{k}" for k in range(n)) for i, (x, n) in enumerate([("a", 9), ("b", 7), ("d", 8)])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, 85).collect()}
    assert got == brute_components(texts, 85) and got[2][1] == 1 and got[0][1] == 0


def test_components(spark):
    draw = random.Random(6)
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, 501 + i) for i in range(80)]
    loose = [(1000 + draw.randrange(60), 1000 + draw.randrange(60)) for _ in range(40)]
    up = {}

    def root(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in chain + star + loose:
        up[root(a)] = root(b)
    rows = near_dedup.components(spark.createDataFrame(chain + star + loose, "a long, b long")).collect()
    label, linked = {r["node"]: r["label"] for r in rows}, {v for a, b in chain + star + loose if a != b for v in (a, b)}
    assert set(label) == linked
    assert all((label[a] == label[b]) == (root(a) == root(b)) for a in linked for b in linked)


def test_signature_is_unbiased():
    draw = np.random.default_rng(5)
    a = draw.integers(0, 1 << 63, 800, np.uint64)
    b = np.concatenate([a[:640], draw.integers(0, 1 << 63, 160, np.uint64)])
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - 640 / 960) < 0.15


def test_decontamination(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8)))
    items = {i: " ".join(word() for _ in range(draw.randint(10, 30))) for i in range(12)} | {100: "tinyxyz", 101: None, 102: ""}
    docs, want = [], set()
    for d in range(60):
        text = " ".join(word() for _ in range(80))
        if d % 2:
            i = draw.randrange(12)
            k = int(len(items[i]) * decontaminate.RATE)
            text = text[:200] + "\n " + mutated(draw, items[i].upper().lower(), k + draw.choice((0, 3))).replace(" ", "  ") + " " + text[200:]
        docs.append((d, text, None))
        for i, t in items.items():
            if t and len(t) >= decontaminate.MIN_CHARS:
                n = decontaminate.normal(text)
                prev = [0] * (len(n) + 1)
                for a, x in enumerate(decontaminate.normal(t), 1):
                    cur = [a]
                    for b, y in enumerate(n, 1):
                        cur.append(min(prev[b] + 1, cur[-1] + 1, prev[b - 1] + (x != y)))
                    prev = cur
                if min(prev) <= int(len(t) * decontaminate.RATE):
                    want.add((d, i, min(prev)))
    df = spark.createDataFrame([*docs, (60, None, None), (61, "", None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 400):
        got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(df, bench, block_chars=block).collect()}
        assert got == want and want
    assert {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()} == set(range(62)) - {w[0] for w in want}
    assert decontaminate.find_leaks(df, bench.where("false")).count() == 0 and decontaminate.drop_leaks(df.where("false"), bench).count() == 0


@pytest.mark.parametrize("block", [decontaminate.BLOCK_CHARS, 40])
def test_items_that_share_an_id(spark, block):
    """All texts of an id are searched, those of a null id too; the closest counts, and repeated documents stay."""
    a, b, c = ("the quick brown fox jumps over the lazy dog", "a quite different item with words of its own", "this item has no identifier of any kind at all")
    bench = spark.createDataFrame([(1, a), (1, b), (1, b), (None, c), (2, a[:-1] + "t")], "item_id long, text string")
    docs = spark.createDataFrame([(1, a), (2, "x " + b), (2, "x " + b), (3, c), (4, f"{a[:-1]}q {b}"), (5, "nothing")], "doc_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.find_leaks(docs, bench, block_chars=block).select("doc_id", "item_id", "distance").collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 1, 0), (3, None, 0), (4, 1, 0), (4, 2, 1)], key=str)
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench, block_chars=block).collect()] == [5]


def test_short_items_are_searched_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Two plus two is  what?"), (2, "four"), (3, "?")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "He said: two plus\ntwo is what? Four."), (2, "fourteen two plus two is whatever"), (3, "petit-four"), (4, "is it? " * 200_000), (5, None)], "doc_id long, text string")
    for block in (decontaminate.BLOCK_CHARS, 5):
        got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(docs, bench, block_chars=block).collect()}
        assert got == {(1, 1, 0), (1, 2, 0), (3, 2, 0), (1, 3, 0), (4, 3, 0)}


def test_decontamination_keeps_other_columns(spark):
    bench = spark.createDataFrame([(1, "one item with some words in it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, 5, "x", "one item with some words in it"), (None, 6, "y", "clean"), (2, 7, "z", None), (2, 7, "z", None)], "doc_id long, distance int, item string, text string")
    out = decontaminate.drop_leaks(docs, bench)
    assert out.columns == docs.columns and sorted((tuple(r) for r in out.collect()), key=str) == sorted([(None, 6, "y", "clean"), (2, 7, "z", None), (2, 7, "z", None)], key=str)


def rule_row(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at, covered = {}, set()
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(spark):
    texts = [None, "", "a", "a b", "a b c a b c", "a a a a a", "x y z\nx y z\n \nx y z", "\x0b\x0c#*<>\r\n", "ä🙂 " * 2000, " ".join(str(i % 60) for i in range(5000)), " nbsp wide stays"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, words string").unionByName(table(spark, SF, "documents").selectExpr("doc_id + 100 AS doc_id", "text", "lang AS words"))
    want = {r["doc_id"]: rule_row(r["text"]) for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.rule_statistics(docs).collect()}
    assert got == want


def test_risk_control(spark):
    assert quality_rules.risk_exceeds(0, 0, 0.1, 0.05) and quality_rules.risk_exceeds(0, 10, 0.1, 0.05) and not quality_rules.risk_exceeds(0, 100, 0.1, 0.05)
    assert quality_rules.risk_exceeds(8, 100, 0.1, 0.05) and not quality_rules.risk_exceeds(3, 100, 0.1, 0.05)
    good = " ".join(f"word{i}" for i in range(100))
    junk = " ".join(f"word{i}###" for i in range(100))
    docs = spark.createDataFrame([(i, junk if i % 5 == 0 else good) for i in range(4000)] + [(-1, None), (None, good)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 5 == 0 else 1) for i in range(4000)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs, labels).collect()}
    assert not rows[0]["kept"] and rows[1]["kept"] and rows[-1]["base_failed"] and not rows[-1]["kept"] and rows[None]["kept"]
    assert all(r["kept"] for i, r in {r["doc_id"]: r for r in quality_rules.quality_verdicts(docs, labels.where("false")).collect()}.items() if i != -1)
    assert quality_rules.quality_verdicts(docs.where("false"), labels).count() == 0
