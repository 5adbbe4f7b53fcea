"""Phrases, BPE and fill-in-middle against brute force and the library, on odd texts."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from requestsieve.llm import bpe, infill, phrases
from requestsieve.llm.tokens import WordTokenizer

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [
    *["a", "B", "é", "ß", "İ", "ﬁ", "1", "٣", "'s", "'", "<|endoftext|>", "<", "|", ">", " ", "  "],
    *["\n", "\n\n", "\t", "\x0b", "\x1f", "\x85", " ", "​", "\x00", ",", "...", "$$$", "-"],
    *["漢", "😀", "Ω", "\r\n", "word", " the", "don't", "½", "œ", "<P>", "<S", "S>", "<M>", "M>"],
]


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 25))) for _ in range(n)]
    return [*texts, "x" * 3000, "ab" * 200 + " " + "é" * 300, "<|endoftext|><|endoftext|>", "a" * 64, "a" * 65]


SCHEMA = (
    "doc_id long, text string, lang string, ids int, n int, form string, output string, decoded int,"
    " rank int, a int, shard int, `p_id` int"
)


def table(spark, rows):
    extra = (1, 2, "spm", "<S>", 3, 4, 5, 6, 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts(300)
    out = [(i, t, "en") for i, t in enumerate(texts)]
    out += [(1000, None, None), (1001, "", "de"), (None, "null id here", "en"), (None, None, None)]
    out += [(1002, "said twice, said twice", "en")] * 2
    return [*out, (-5, "negative id of many words " * 20_000, "en")]


def test_word_cache_gives_the_library_ids():
    texts = odd_texts(4000, 7)
    for path, spaced in ((WORDS, False), (BYTES, True)):
        own = WordTokenizer(path, spaced, most_words=50)
        library = Tokenizer.from_file(path)
        for a in range(0, len(texts), 500):
            part = texts[a : a + 500]
            ids, ends = own.encode(pa.array(part))
            found = [x.tolist() for x in np.split(ids, ends[:-1])]
            assert found == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_trees_merge_leftmost_pairs_of_lowest_rank():
    rng = random.Random(1)
    pairs = [(rng.randrange(6), rng.randrange(6)) for _ in range(20)]
    pairs = list(dict.fromkeys(pairs))
    pairs += [(6 + rng.randrange(len(pairs)), rng.randrange(6)) for _ in range(20)]
    pairs = list(dict.fromkeys(pairs))
    merges = bpe.Merges(pairs, [6 + k for k in range(len(pairs))])
    rank = {p: k for k, p in enumerate(pairs)}

    def plain(ids):
        while found := [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank]:
            k, i = min(found)
            ids = [*ids[:i], 6 + k, *ids[i + 2 :]]
        return ids

    words = [[rng.randrange(6) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 64, 65, 200]))] for _ in range(300)]
    words.insert(5, [])
    sizes = np.array([len(w) for w in words])
    ids, counts = bpe.merge_all(np.concatenate([np.array(w, dtype=np.int64) for w in words]), sizes, merges)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain(w) for w in words]
    assert [bpe.merge_one(w, merges) for w in words if w] == [plain(w) for w in words if w]


def test_bpe_encodes_and_decodes_as_the_library(spark, rows):
    library = Tokenizer.from_file(BYTES)
    docs = table(spark, rows)
    found = bpe.decode(bpe.encode(docs, BYTES), BYTES)
    assert set(found.columns) == set(docs.columns)
    assert dict(found.dtypes)["ids"] == "array<int>"
    got = Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in found.collect())
    wanted = Counter()
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted[i, t, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == wanted
    assert bpe.decode(bpe.encode(docs.limit(0), BYTES), BYTES).count() == 0


def test_decoding_replaces_what_is_not_text(spark):
    library = Tokenizer.from_file(BYTES)
    rng = random.Random(2)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    lists += [None, [], [50256], [60_000, 64, -1]]
    found = bpe.decode(
        spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>"), BYTES
    )
    for r in found.collect():
        assert r.decoded == library.decode([i for i in r.ids or [] if 0 <= i < 50257], skip_special_tokens=False)


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infilled(doc_id, text):
    units = UNIT.findall(text)
    n = len(units)
    digest = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilling_and_its_inverse(spark, rows):
    docs = table(spark, rows)
    moved = infill.transform(docs)
    assert set(moved.columns) == {*docs.columns, "prefix_chars", "middle_chars"}
    found = infill.restore(moved.drop("text"))
    got = Counter(
        (r.doc_id, r.restored, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))
        for r in found.collect()
    )
    assert got == Counter((i, t or "", infilled(i, t or "")) for i, t, _ in rows)
    assert {"plain", "psm", "spm"} == {k[2][1] for k in got}
    assert infill.restore(infill.transform(docs.limit(0))).count() == 0


def test_marker_parts_beside_markers(spark):
    texts = ["<", "<S <P <M", "<S\nx> <", "S> P> M>", "a <S", "<<< <<", "<M <M <M"]
    rows = [(i, texts[i % len(texts)], None) for i in range(400)]
    found = infill.restore(infill.transform(table(spark, rows)))
    for r in found.collect():
        assert (r.output, r.restored) == (infilled(r.doc_id, r.text)[-1], r.text)
    none = spark.createDataFrame([(None, None)], "output string, form string")
    assert infill.restore(none).first().restored == ""


def mined(rows, least, top=2000):
    lists, totals = [], Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            lists.append(("und" if lang is None else lang, words))
            totals["und" if lang is None else lang] += len(words)
    f = Counter(
        (lang, tuple(w[i : i + m])) for lang, w in lists for m in (1, 2, 3, 4) for i in range(len(w) - m + 1)
    )
    f = {k: a for k, a in f.items() if a >= least}
    out = {}
    for (lang, g), a in f.items():
        if len(g) == 1:
            continue
        cuts = [
            (2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))
        ]
        score, k = min(cuts)
        inside = any(
            other == lang and len(h) > len(g) and 100 * b >= 80 * a
            and any(h[i : i + len(g)] == g for i in range(len(h)))
            for (other, h), b in f.items()
        )
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {
        (lang, rank, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in out.items()
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


def prose(seed, n):
    rng = random.Random(seed)
    words = ["the", "The", "of", "king", "é", "ab", "x\x00y", "\x1f", "zoo", "new", "york", "city"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", ":"]
    texts = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 30)))
        texts.append(text + ("new york city hall " * rng.randint(0, 3) if rng.random() < 0.4 else ""))
    return [(i, t, rng.choice(["en", "en", "de", None, ""])) for i, t in enumerate(texts)]


@pytest.mark.parametrize("shard_words", [phrases.SHARD_WORDS, 40])
def test_phrases_are_those_of_brute_force(spark, shard_words):
    rows = prose(3, 400)
    rows += [(None, None, "en"), (900, "", None), *[(901, "new york city hall", "en")] * 3]
    rows.append((902, "a b c d e " * 3_000 + ". " + "long " * 20_000, "fr"))
    for least, top in ((8, 2000), (5, 7)):
        found = phrases.collocations(table(spark, rows), least=least, top=top, shard_words=shard_words)
        columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        got = [tuple(r) for r in found.select(columns).collect()]
        assert len(got) == len(set(got))
        assert set(got) == mined(rows, least, top)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(table(spark, [(1, "", None)]).limit(0)).count() == 0
    assert phrases.collocations(table(spark, [(1, None, None), (2, " .\t", "en")])).count() == 0


def test_numbers_of_extensions(spark):
    rows = [(i, f"big {['red', 'blue'][i % 2]} dog ran" + " home" * (i % 3 > 0), "en") for i in range(60)]
    found = {r.phrase: r for r in phrases.collocations(table(spark, rows), least=5, percent=101).collect()}
    assert (found["dog ran"].left_extensions, found["dog ran"].right_extensions) == (2, 1)
    assert found["red dog"].left_extensions == 1
    assert found["big red dog ran"].left_extensions is None


def test_scores_are_exact_beyond_64_bits(spark):
    big = 7 * 10**12 + 1
    row = [(big, [big + 3, big + 5], [big + 9, big + 2])]
    cut = spark.createDataFrame(row, "a long, heads array<long>, tails array<long>").select(phrases._weakest_cut()).first()[0]
    wanted = min((2_000_000 * big // s, k) for k, s in ((1, 2 * big + 5), (2, 2 * big + 14)))
    assert (cut.score, cut.k) == wanted


def test_steps_of_the_index_reach_every_longer_phrase():
    rows = prose(9, 300)
    shard = phrases.Shard()
    shard.add(pa.array([t for _, t, _ in rows]), pa.array(["x"] * len(rows)))
    ((raw, names, _, starts, counts),) = shard.indexes(10**9)
    bwt = np.frombuffer(raw, "<u4").astype(np.int32)
    known = {i: (w,) for i, w in enumerate(names.to_pylist())}
    lo, n = starts, counts
    for m in (2, 3, 4):
        prefix, suffix, at, size = phrases.extend(bwt, counts, lo, n, np.arange(len(known)))
        longer = [(*known[p], known[s][-1]) for p, s in zip(prefix, suffix, strict=True)]
        assert all(known[s] == g[1:] for s, g in zip(suffix, longer, strict=True))
        every = mined_counts(rows, m)
        assert dict(zip(longer, size, strict=True)) == every and len(longer) == len(every)
        known, lo, n = dict(enumerate(longer)), at, size


def mined_counts(rows, m):
    counts = Counter()
    for _, text, _ in rows:
        low = re.sub("[A-Z]", lambda x: x[0].lower(), text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts
