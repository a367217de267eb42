"""Token counts, periodic runs and spelling variants against the library and brute force, on odd small tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from caselens.llm import periodic, spelling, token_machine

SCHEMA = "doc_id long, text string, word string, n int, id string, number int, digest string, role int, size int, start int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "w", 1, "x", 2, "d", 3, 4, 5) for i, t in rows], SCHEMA)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


# token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def machine():
    return token_machine.machine(PATH, token_machine.character_kinds())


PARTS = ["'s", "'re", "'ll", "'", "t", "m", "d", " ", "  ", "\n", "\t", "　", "\xa0", "1", "²", "Ⅷ", "a", "é", "中文", "!", "..", "=====", "<|endoftext|>", "<|", "😀", " '", "aaaaaaa", "the", "ing", "\U00031350", "\x85"]


def test_the_machine_counts_like_the_library(machine, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(14)))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    spans = ((0x20, 0x7F), (0x20, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x110000))
    for _ in range(2000):
        text = "".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(20)))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_annotations_add_up_to_the_count_of_every_prefix(machine, library):
    text = "They've   seen\n\n 12 naïve  co-operators' <|endoftext|> aaaaaaaaaaaaaaaaaaaaa"
    key, total = token_machine.START, 0
    for k, c in enumerate(text.split("<|endoftext|>")[0]):
        key, n = machine.run(key, c)
        total += n
        assert total == len(library.encode(text[: k + 1], add_special_tokens=False).ids)


def test_forgetting_transitions_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(token_machine, "TRANSITIONS", 20)
    own = token_machine.TokenMachine(PATH, token_machine.character_kinds())
    for text in ("one two three four", "five six seven", "one two three four five"):
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)


ODD = [
    (1, "a" * 50000), (2, "ab" * 7000), (3, " " * 9000 + "x"), (4, "中文" * 4000), (5, "<|endoftext|>" * 500), (6, "x" * 995 + "<|endoftext|>" * 300),
    (7, None), (8, ""), (9, "=" * 7777), (None, "'s" * 3000), (1, "a" * 50000), (10, "a" * 50000), (11, "short text"), (None, None),
]


@pytest.mark.parametrize("look_back,starts", [(64, 16), (4, 1)])
def test_chunk_maps_compose_to_whole_counts(spark, library, monkeypatch, look_back, starts):
    # with little to look back at, states aren't foreseen and texts are run through whole
    for name, value in (("CHUNK_CHARS", 1000), ("FAN_IN", 3), ("LOOK_BACK", look_back), ("STARTS", starts)):
        monkeypatch.setattr(token_machine, name, value)
    got = listed(token_machine.count_tokens(frame(spark, ODD), PATH))
    counts = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    assert got == sorted(((i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(ODD, counts, strict=True)), key=repr)


def test_the_scan_tells_state_and_count_before_every_chunk(spark, machine, monkeypatch):
    from caselens.llm.store import Scratch

    monkeypatch.setattr(token_machine, "CHUNK_CHARS", 100)
    monkeypatch.setattr(token_machine, "FAN_IN", 2)
    text = "It's a text of words, again and again. " * 40
    rows = []
    for number, before, body in machine.chunks(text):
        entered = machine.foreseen(before) if number else [token_machine.START]
        ended = [machine.run(k, body) for k in entered]
        rows.append((b"d", number, token_machine._written(entered), token_machine._written([k for k, _ in ended]), [n for _, n in ended]))
    scanned = token_machine.scan_maps(Scratch(spark), spark.createDataFrame(rows, token_machine._MAPS)).orderBy("number").collect()
    for k, r in enumerate(scanned):
        assert token_machine.state_of(bytes(r["state"])) == machine.run(token_machine.START, text[: 100 * k])[0]
        assert (r["before"], r["after"]) == (machine.count(text[: 100 * k]), machine.count(text[: 100 * (k + 1)]))


def test_counts_of_the_documents_and_an_empty_table(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = [(i, len(t.encode()), n, n > 512) for i, t in rows for n in [len(library.encode(t, add_special_tokens=False).ids)]]
    assert listed(token_machine.count_tokens(docs, PATH)) == sorted(want, key=repr)
    assert token_machine.count_tokens(frame(spark, []), PATH).collect() == []


# periodic runs


def runs_by_hand(words, least=6, power=4):
    n, out = len(words), []
    for p in range(1, n // power + 1):
        i = 0
        while i < n - p:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            end = j + p
            if end - i >= max(least, power * p) and not any(all(words[k] == words[k + q] for k in range(i, end - q)) for q in range(1, p)):
                out.append((i, end - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_with_runs(rng):
    k = rng.choice([1, 2, 2, 3, 4])
    words = [rng.randrange(1, k + 1) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(words) + 1)
        block = [rng.randrange(1, k + 1) for _ in range(rng.randrange(1, 6))] * rng.randrange(3, 8)
        words[at:at] = block + block[: rng.randrange(4)]
    return words


def test_lyndon_roots_give_all_runs():
    rng = random.Random(3)
    for _ in range(1500):
        words = words_with_runs(rng)
        assert periodic.runs_of(words) == runs_by_hand(words)
        assert sorted(periodic.runs_of(words, 2, 2), key=lambda r: (r[0], r[2])) == runs_by_hand(words, 2, 2)
        # stretches without frequent neighbours hold no run
        assert periodic.periodic_runs(words) == runs_by_hand(words)


def test_common_extensions_are_those_of_the_text():
    rng = random.Random(4)
    for _ in range(100):
        words = [rng.randrange(1, 3) for _ in range(rng.randrange(2, 50))]
        tree = periodic.SuffixTree(words)
        pairs = [(a, b) for a in range(len(words) + 1) for b in range(len(words) + 1) if a != b]
        got = tree.common(*(np.array(c) for c in zip(*pairs, strict=True)))
        for (a, b), n in zip(pairs, got.tolist(), strict=True):
            m = 0
            while a + m < len(words) and b + m < len(words) and words[a + m] == words[b + m]:
                m += 1
            assert n == m


def run_row(doc_id, text, tails):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 0
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    shape = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(runs), *shape, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def test_runs_of_odd_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(map(str, words_with_runs(rng)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (None, "a b " * 20), (50, "x " * 7), (53, "buy now " * 4000 + "end"), (54, "é é " * 9), (55, "a a a a a b b b b b b")]
    for tails in (False, True):
        got = {r for r in map(tuple, periodic.run_table(frame(spark, rows), periodic_tails=tails).collect()) if r[0] != 53}
        assert got == {run_row(*r, tails) for r in rows if r[0] != 53}
    long = periodic.run_table(frame(spark, rows), with_runs=True).where("doc_id = 53").first()
    assert (long["n_runs"], long["start"], long["length"], long["period"], long["collapsed"]) == (1, 0, 8000, 2, "buy now end")
    assert periodic.run_table(frame(spark, [])).collect() == []


def test_runs_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((run_row(r["doc_id"], r["text"], True) for r in docs.collect() if len(r["text"] or "") < 6000), key=repr)
    got = listed(periodic.run_table(docs.where("length(coalesce(text, '')) < 6000"), periodic_tails=True))
    assert got == want


# spelling variants


def spellings_by_hand(rows, shorten):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if shorten and h % shorten == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= 7
    kept = {w: n for w, n in counts.items() if n >= 2}
    near, pattern = collections.defaultdict(set), collections.defaultdict(set)
    for w in kept:
        for k in range(len(w)):
            pattern[w[:k], w[k + 1 :]].add(w)
            less = w[:k] + w[k + 1 :]
            if less in kept:
                near[w].add(less)
                near[less].add(w)
    for group in pattern.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-kept[x], x), default=None) for w in kept}
    form = {w: b if b and kept[b] >= 10 * kept[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), kept[form[w]] if form[w] else None) for w, n in kept.items()), key=repr)


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(2)
    letters = "abcdeÉßz"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 12))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(80):
            w = rng.choice(base[:5] + base)
            k = rng.randrange(len(w))
            if rng.random() < 0.3:
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((i, rng.choice([" ", "\n", "-", "1"]).join(words)))
    return [*rows, (None, rows[0][1]), (0, rows[0][1]), (1, None), (2, ""), (3, " ".join(["q" * 300] * 2 + ["q" * 301] * 30))]


@pytest.mark.parametrize("box", [1 << 14, 64])
def test_spelling_variants_are_those_one_edit_away(spark, misspelt, monkeypatch, box):
    if box == 64:
        # many boxes, deep trees and small arrays
        for name, value in (("BOX_WORDS", 64), ("SAMPLE_WORDS", 200), ("LEAF", 3), ("ARRAY_CELLS", 2000), ("HELD_WORDS", 100)):
            monkeypatch.setattr(spelling, name, value)
    assert listed(spelling.spelling_groups(frame(spark, misspelt), shorten=31)) == spellings_by_hand(misspelt, 31)


def test_roots_follow_forms_to_the_last_and_ties_go_to_the_smallest(spark):
    texts = ["abcdefgh " * 500, "abcdefghi " * 40, "abcdefghij " * 3, "zbcdefghij " * 30, "bbcdefghij " * 30]
    got = {r["word"]: r for r in spelling.spelling_groups(frame(spark, list(enumerate(texts)))).collect()}
    assert (got["abcdefghij"]["form"], got["abcdefghij"]["root"], got["abcdefghij"]["n_near"]) == ("abcdefghi", "abcdefgh", 3)
    assert (got["bbcdefghij"]["form"], got["bbcdefghij"]["root"], got["bbcdefghij"]["form_n"]) == (None, "bbcdefghij", None)
    assert spelling.spelling_groups(frame(spark, [])).collect() == []


def test_spelling_variants_of_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert listed(spelling.spelling_groups(docs, shorten=31)) == spellings_by_hand(rows, 31)
