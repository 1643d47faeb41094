"""The prefix trie, the token files and the spelling variants against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import common, huffman, prefix_trie, queries, spelling, token_files
from cohortlens.llm.slots import SlotTable, distinct

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- minimal perfect hash and prefix trie ----------------------------------

def test_slots_are_a_bijection_and_verified():
    g = np.random.default_rng(3)
    high, low = g.integers(0, 40, 3000, dtype=np.uint64), g.integers(0, 40, 3000, dtype=np.uint64)
    keys = distinct(high, low)
    assert sorted(zip(*(k.tolist() for k in keys), strict=True)) == sorted(set(zip(high.tolist(), low.tolist(), strict=True)))
    table = SlotTable(*keys)
    found = table.slots(*keys)
    assert sorted(found.tolist()) == list(range(len(table)))
    assert (table.slots(high, low) == table.slots(high.copy(), low.copy())).all()
    with pytest.raises(ValueError, match="without a slot"):
        table.slots(np.array([41], np.uint64), np.array([3], np.uint64))
    assert len(SlotTable(*distinct(high[:0], low[:0]))) == 0


def plain_trie(rows):
    """conv_id -> nodes, from the wording of the contract."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            keys = [int(sha[i:i + 15], 16) for i in (0, 15, 30)]
            convs[conv].append(((turn is not None, turn or 0), role, keys, text))
    convs = {c: [(x[1], x[3]) for x in sorted(own, key=lambda x: x[:3])] for c, own in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) if children[node] else 1
        own = (len(members[node]) - 1) * len(WORD.findall(node[-1][1])) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    return sorted((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(n)).encode()).hexdigest())
                  for n, m in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, owner string, part int"


def found_trie(df, **bounds):
    return sorted(tuple(r[c] for c in TRIE) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(df), **bounds).collect())


def test_trie_of_the_table(spark, sf):
    rows = common.read_table(spark, sf, "conversations")
    wanted = plain_trie([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
    assert sorted(tuple(r[c] for c in TRIE) for r in queries.op11_prefix_trie(spark, sf).select(TRIE).collect()) == wanted


def test_trie_of_awkward_rows(spark):
    rows = []
    for c in range(60):
        for t in range(c % 6):
            rows.append((c, t, "user" if t % 2 == 0 else None, f"hello there {t // 2}" if c % 3 else f"hi {c % 2}\n\t{t}"))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 180) for t in range(4)]  # copies
    rows += [(200, None, "b", "no number"), (200, None, "a", None), (200, None, "a", None), (200, 3, None, ""), (None, 1, "a", "lost"),
             (220, 1, "a", "x"), (20, 5, "user", "w " * 5000)]
    rows += [(241, t, "user", f"long {t % 7}") for t in range(70)] + [(245, t, "user", f"long {t % 7}") for t in range(90)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATIONS).repartition(5)
    wanted = plain_trie(rows)
    assert found_trie(table) == wanted
    assert found_trie(table, depths=8, most=40) == wanted  # paths of many blocks, many shards
    assert found_trie(table.limit(0)) == []
    assert found_trie(table.where("conv_id is null")) == []


def test_a_hot_conversation_is_numbered_by_ranges(spark):
    rows = [(7, i // 2, "user", f"turn {i}") for i in range(4000)] + [(c, 0, "user", "one") for c in range(100, 140)]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], CONVERSATIONS)
    found = prefix_trie.numbered_turns(prefix_trie.slim_turns(table)).toPandas()
    own = found[found.conv_id == 7]
    assert sorted(own.pos) == list(range(1, 4001)) and (found[found.conv_id != 7].pos == 1).all()


# --- token ids -------------------------------------------------------------

def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(queries.TOKENIZER)


def plain_tokens(texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 50), max_size=40), st.integers(0, 30))
def test_code_lengths_are_optimal_under_their_limit(counts, spare):
    counts = np.array(counts, np.int64)
    lengths = huffman.code_lengths(counts, 4)
    used = lengths[counts > 0].astype(int)
    n = len(used)
    limit = max(4, (n - 1).bit_length()) if n else 4
    assert (lengths[counts == 0] == 0).all() and (used <= limit).all()
    if n > 1:
        assert sum(2.0 ** -used) == 1.0
        best = min_cost(sorted(counts[counts > 0].tolist()), limit)
        assert int((counts * lengths).sum()) == best
    ids = np.repeat(np.flatnonzero(counts > 0), 3 + spare)
    np.random.default_rng(spare).shuffle(ids)
    sizes = np.array([len(ids) // 2, 0, len(ids) - len(ids) // 2], np.int64)
    stream, at, words = huffman.encode(ids, sizes, huffman.canonical_codes(lengths), lengths)
    assert words.sum() * 4 == len(stream)
    assert (huffman.Decoder(lengths).decode(stream, at, sizes) == ids).all()


def min_cost(weights, limit):
    """Cost of the best code by dynamic programming over the number of inner nodes of each depth."""
    n = len(weights)
    weights = sorted(weights, reverse=True)
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    best = {(0, 2): 0}  # (symbols placed, free nodes of this depth) -> cost of everything above
    for depth in range(1, limit + 1):
        after = {}
        for (placed, free), cost in best.items():
            for leaves in range(min(free, n - placed) + 1):
                inner = free - leaves
                now = cost + depth * (sums[placed + leaves] - sums[placed])
                if placed + leaves == n and inner == 0:
                    after[("end",)] = min(now, after.get(("end",), now))
                elif inner and placed + leaves < n and 2 * inner <= 2 * n:
                    key = (placed + leaves, min(2 * inner, 2 * n))
                    after[key] = min(now, after.get(key, now))
        if ("end",) in after:
            done = after.pop(("end",))
            best_end = min(done, best_end) if "best_end" in dir() else done
        best = after
    return best_end


def test_canonical_codes_are_prefix_free_and_ordered():
    lengths = huffman.code_lengths(np.random.default_rng(2).integers(0, 90, 500))
    codes = huffman.canonical_codes(lengths)
    words = sorted(f"{int(c):0{n}b}" for c, n in zip(codes, lengths, strict=True) if n)
    assert all(not b.startswith(a) for a, b in zip(words, words[1:], strict=False))
    order = sorted((n, i) for i, n in enumerate(lengths.tolist()) if n)
    assert [f"{int(codes[i]):0{n}b}" for n, i in order] == words


TEXTS = {5: "Hello, World 1000 times!", 3: None, 9: "", 11: " \t\n ", 12: "x" * 20000, 13: "a\x1cb\x1db c\x0bd\x0ce 007 0 00",
         14: "<|endoftext|> a<|startoftext|>b ÉÈ ́x é", 15: "word " * 3000, 16: "Ünïcödé nb em ſt ΑΣ σς İ", None: "no id", 4: "Hello, World 1000 times!", 17: "'s don't 0'll"}


@pytest.mark.parametrize("by_word", [True, False])
def test_token_files_round_trip(spark, by_word):
    rows = [*TEXTS.items(), (5, "again"), (5, "again"), (-4, "smallest")]
    table = spark.createDataFrame([(i, t, 1, "y", "z") for i, t in rows], "doc_id long, text string, n long, ids string, bits string").repartition(4)
    path = common.scratch_path(spark, "test-tokens")
    token_files.write_token_files(table, path, tokenizer_path(), 1, by_word, segment=50)
    found = token_files.read_token_files(spark, path, with_ids=True).orderBy("start").toPandas()
    ids = [None if i != i else int(i) for i in found.doc_id]
    assert ids == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    wanted = Counter(zip([i for i, _ in rows], plain_tokens([t for _, t in rows]), strict=True))
    assert Counter(zip(ids, found.ids.map(bytes), strict=True)) == wanted
    assert found.start.tolist() == (found.n_tokens.cumsum() - found.n_tokens).tolist()
    assert (found.n_tokens == found.ids.map(len) // 4).all() and (found.ids_crc32 == found.ids.map(zlib.crc32)).all()


def test_token_files_of_the_table_and_of_nothing(spark, sf):
    docs = common.read_table(spark, sf, "documents").orderBy("doc_id").toPandas()
    tokens = plain_tokens(docs.text)
    n = np.array([len(t) // 4 for t in tokens])
    found = queries.op12_token_files(spark, sf).orderBy("doc_id").toPandas()
    assert found.doc_id.tolist() == docs.doc_id.tolist() and found.n_tokens.tolist() == n.tolist()
    assert found.start.tolist() == (n.cumsum() - n).tolist() and found.ids_crc32.tolist() == [zlib.crc32(t) for t in tokens]
    path = common.scratch_path(spark, "test-none")
    token_files.write_token_files(common.read_table(spark, sf, "documents").limit(0), path, tokenizer_path(), 1)
    assert token_files.read_token_files(spark, path).count() == 0


def test_a_damaged_stream_is_noticed():
    lengths = huffman.code_lengths(np.array([9, 5, 3, 1, 1]))
    ids = np.random.default_rng(1).integers(0, 5, 700)
    stream, at, _ = huffman.encode(ids, np.array([700]), huffman.canonical_codes(lengths), lengths)
    at = at.copy()
    at[1] += 1
    with pytest.raises(ValueError, match="checkpoint"):
        huffman.Decoder(lengths).decode(stream, at, np.array([700]))


# --- spelling --------------------------------------------------------------

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


@settings(deadline=None, max_examples=150)
@given(st.sets(st.text("abÀé", min_size=1, max_size=6), max_size=80))
def test_near_pairs_are_all_pairs_one_edit_apart(words):
    words = sorted(words)
    i, j = spelling.near_pairs(words) if words else ((), ())
    found = [(words[a], words[b]) for a, b in zip(i, j, strict=True)]
    assert len(found) == len(set(found))
    assert set(found) == {(a, b) for a in words for b in words if one_edit(a, b)}


def plain_groups(rows):
    runs, counts = re.compile("[A-Za-zÀ-ÿ]+"), Counter()
    for doc_id, text in rows:
        for run in runs.findall(text or "") if doc_id is not None else ():
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    shorter = defaultdict(set)  # words that agree without one letter, or are that
    for w in n:
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            shorter[k].add(w)
    near = {w: {v for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))} for v in shorter[k] if one_edit(v, w)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return {w: (form[w], root[w], n[w], len(near[w]), n.get(form[w])) for w in n}


GROUPS = ["form", "root", "n", "n_near", "form_n"]


def as_dict(df):
    return {r["word"]: tuple(r[c] for c in GROUPS) for r in df.collect()}


def test_spelling_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = common.read_table(spark, sf, "documents").select("doc_id", "text").collect()
    wanted = plain_groups([(r.doc_id, r.text) for r in rows])
    assert sum(w[0] is not None for w in wanted.values()) > 10
    assert as_dict(queries.op13_spelling(spark, sf)) == wanted


def test_spelling_of_awkward_rows(spark):
    g = np.random.default_rng(8)
    stem = "abcdéÀ"
    words = ["".join(stem[x] for x in g.integers(0, 6 if k % 3 else 2, 5 + k % 4)) for k in range(900)]
    texts = [" ".join(np.array(words)[g.zipf(1.3, 700) % 900]) for _ in range(40)]
    long = "z" * 3000
    rows = [*enumerate(texts), (50, None), (51, ""), (52, " \n"), (53, " ".join([long] * 5 + [long + "y"] * 30)), (None, "lonely " * 9),
            (54, "WORDING wordinG×÷ ÀÀÀÀÀÀ àÀÀÀÀÀ " * 6), (54, "repeated " * 6), (54, "repeated " * 6), (55, "chainaa " * 5 + "chainab " * 25 + "chainbb " * 125)]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    wanted = plain_groups(rows)
    found = as_dict(spelling.spelling_groups(spelling.word_counts(table, slip=199)))
    assert found == wanted and found["chainaa"][:2] == ("chainab", "chainbb")
    counted = spelling.word_counts(table, slip=199, held=100)
    near = {(r["word"], r["near"]) for r in spelling.near_words(counted, file=12).collect()}  # files that are divided again
    assert near == {(a, b) for a in wanted for b in wanted if one_edit(a, b)}
    assert spelling.spelling_groups(spelling.word_counts(table.limit(0))).count() == 0
    assert spelling.word_counts(table.where(F.col("doc_id") == 54), least_count=20).count() == 0
