"""Operators that judge each row for itself: quality, personal data, tokens, licences, benchmark passages."""
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from kindred.llm import decontaminate, licences, pii, quality, tokens
from tests.llm import brute

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_quality_measures_equal_plain_ones(docs, messy, none):
    got = quality.ledger(docs).select("doc_id", "text", "ledger.*", quality.kept("full-1").alias("kept")).collect()
    assert len(got) == len(messy)
    for r in got:
        want = brute.quality(r["text"])
        assert {k: r[k] for k in want if k != "base_failed"} == {k: v for k, v in want.items() if k != "base_failed"}
        assert bool(r["failed"] & quality.mask("base-1")) == want["base_failed"]
        assert not (want["base_failed"] and r["kept"])
    assert quality.ledger(none).count() == 0
    assert set(docs.columns) == set(quality.ledger(docs).columns)
    same = docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in ("own_text", "OWN_WORDS", "own_lines", "_own_text")])
    assert quality.ledger(same).drop("ledger").exceptAll(same).count() == 0


def test_quality_repeats_within_long_text(spark):
    text = " ".join(f"w{i}" for i in range(3000)) + " " + " ".join(f"w{i}" for i in range(100, 130)) + " x " + " ".join(["y"] * 20)
    r = quality.ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).select("ledger.*").first()
    assert r["n_repeat_words"] == brute.quality(text)["n_repeat_words"]


def test_rules_catch_junk_and_leave_prose(spark):
    prose = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + "."
    rows = [(1, prose), (2, prose.replace(" ", "### ")), (3, prose.upper()), (4, prose.replace(" ", " | ")), (5, "\n".join(["a b c d e f g"] * 9)),
            (6, prose + " 12-34 (see I.)")]
    got = quality.ledger(spark.createDataFrame(rows, "doc_id long, text string")).where(quality.kept("full-1"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 6]


def test_ablation_from_bits(spark, docs):
    judged = quality.ledger(docs)
    got = {(r["policy"], r["rule"]): r for r in quality.ablation(judged).collect()}
    bits = [r[0] for r in judged.select("ledger.failed").collect()]
    for policy, rules in quality.POLICIES.items():
        m = quality.mask(policy)
        for rule in rules:
            b, r = quality.BITS[rule], got[policy, rule]
            assert (r["n_docs"], r["n_rejected"], r["n_failed"], r["n_only"]) == (
                len(bits), sum(x & m > 0 for x in bits), sum(x & b > 0 for x in bits), sum(x & m == b for x in bits))
    empty = quality.ablation(judged.where("doc_id = -1")).collect()
    assert len(empty) == len(got) and all(r["n_docs"] == r["n_only"] == r["met_rules"] == 0 for r in empty)


PIECES = st.sampled_from(["a.b@c.de", "@x.y", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (843) 555-4223",
                          "+12", "+1234567890123456", "é", " ", "\n", "-", ".", "00012.1.1.1", "4111111111111111", "a@b", "x@y.z@q.r"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=12))
def test_base_spans_equal_plain_patterns(pieces):
    text = "".join(pieces)
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute.pii(text)


def test_long_words_take_no_quadratic_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "@" * 100_000, "a@" * 100_000, "+1" * 100_000, "+1 " * 100_000):
        pii.seeds(text, pii.base_spans(text))


def test_contexts_teach_unseen_identifiers(spark):
    seeds = [next(c for c in (f"41{i:013d}{d}" for d in range(10)) if pii.luhn(c)) for i in range(1000, 1008)]
    rows = [(i, f"pay by card number {c} before noon today") for i, c in enumerate(seeds)]
    rows += [(20, "pay by card number 4100000000009999 before noon today"), (21, "the order 20240117 left"), (22, None), (23, "card number of 123456789 pages here")]
    docs = spark.createDataFrame(rows + rows[8:9], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    assert not pii.luhn("4100000000009999")
    assert [s.kind for s in got[20]["learned"]] == [2] and got[20]["learned"][0].asDict() == {"kind": 2, "start": 19, "stop": 35}
    assert not got[21]["learned"] and not got[22]["base"] and not got[23]["learned"]
    assert pii.find(docs).count() == len(rows) + 1


def _learned(spark, rows):
    """{doc_id: [(kind, text)]} of the learned spans."""
    text = dict(rows)
    got = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    return {r["doc_id"]: [(pii.KINDS[s.kind], text[r["doc_id"]][s.start:s.stop]) for s in r["learned"]] for r in got if r["learned"]}


def test_slots_of_several_words(spark):
    """Numbers with blanks, short ids and user names in the contexts of seeds; nothing in the same words elsewhere."""
    rows = [(i, f"please call +1 617 555 {1200 + i} after lunch, or write to user{chr(97 + i)}@x.org until noon") for i in range(12)]
    rows += [(20, "é please call 617 555 1212 after lunch"), (21, "please call (617) 555-1313 after lunch"), (22, "please call AB-1234 after lunch"),
             (23, "or write to jane_doe until noon"), (24, "in 1999 they had 617 555 1212 pages, 20240117 of them by jane_doe"), (25, "please wait 12345 days after lunch")]
    want = {20: [("phone", "617 555 1212")], 21: [("phone", "(617) 555-1313")], 22: [("phone", "AB-1234")], 23: [("email", "jane_doe")]}
    got = _learned(spark, rows)
    # 24: strings that were identified are identifiers wherever a pattern meets them, and only there
    assert got == want


def test_what_was_learned_teaches_in_turn(spark):
    """The words around learned strings are patterns of the next turn: one pattern of seeds alone does not do for the last row."""
    rows = [(i, f"please call +1 617 555 {1200 + i} after lunch") for i in range(40)]
    rows += [(100 + i, f"please call 617 555 {2200 + i} after dinner") for i in range(7)] + [(200, "we call 617 555 9999 after dinner")]
    got = _learned(spark, rows)
    assert got[200] == [("phone", "617 555 9999")] and got[102] == [("phone", "617 555 2202")] and len(got) == 8


def test_fillers_without_trust_teach_nothing(spark):
    """A pattern that meets as much prose as seeds is not trusted, and clean prose has no span."""
    rows = [(i, f"please call +1 617 555 {1200 + i} after lunch") for i in range(12)]
    rows += [(20 + i, f"please call {'abcdefghijkl'[i] * 3} after lunch") for i in range(12)] + [(40, "please call 617 555 1212 after lunch")]
    assert _learned(spark, rows) == {}


def test_slots_equal_plain_ones(spark):
    """Hits of the packed reader, pattern by pattern, against a plain walk over the words."""
    import random

    import numpy as np
    from xxhash import xxh64_intdigest
    rnd = random.Random(5)
    words = ["aa", "bb", "cc", "12", "3456", "x_y", "-", "(617)", "a@b.cd", "555"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(12)))) for i in range(60)]
    seen, want = set(), set()
    for i, t in rows:
        w = pii.folded(t.encode())
        h = np.array([xxh64_intdigest(x) for x in w], np.uint64)
        for a in range(len(w)):
            for b in range(a + 1, min(a + pii.SLOT, len(w)) + 1):
                if pii.shaped(w[a:b]):
                    seen.update((i, p) for p in pii.around(h, a, b))
    patterns = sorted({p for _, p in seen})[::3]
    sieve = pii.Sieve(spark.createDataFrame([(p,) for p in patterns], "p long"))
    found = spark.createDataFrame(rows, "key long, text string").mapInArrow(pii._slots(sieve), pii.HITS).where("instance IS NOT NULL").collect()
    text = dict(rows)
    for r in found:
        if r["pattern"] in patterns:
            assert r["pattern"] in r["around"] and r["instance"] == text[r["key"]][r["start"]:r["stop"]] and "a@b.cd" not in r["instance"]
            want.add((r["key"], r["pattern"]))
    free = {k for k, t in rows if "a@b.cd" not in t}
    assert {x for x in want if x[0] in free} == {x for x in seen if x[1] in patterns and x[0] in free}


def test_personal_data_of_messy_rows(docs, messy, none):
    got = pii.find(docs).collect()
    assert len(got) == len(messy) and pii.find(none).count() == 0


def test_token_counts_equal_the_library(docs, messy, none, spark):
    library = Tokenizer.from_file(VOCABULARY)
    text = {i: t for i, t, _ in messy}
    odd = {500: "<|endoftext|> a<|endoftext|>", 501: "\u0085\u180e\u200b\x1c\x1d a\u2028b", 502: "".join(map(chr, range(1, 0x3000))), 503: "it's  we'LL\t\n  x",
           504: "𐀀𖭀🄀ꟊ𞤀ⅷ①٣", 505: "".join(chr(c) for c in range(0x10000, 0x20000, 37))}
    text |= odd
    more = spark.createDataFrame(list(odd.items()), "doc_id long, text string")
    got = tokens.count_tokens(docs.select("doc_id", "text").union(more), VOCABULARY).collect()
    assert len(got) == len(messy) + len(odd)
    for r in got:
        if r["doc_id"] is not None:
            t = text[r["doc_id"]] or ""
            n = len(library.encode(t, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 1024)
    assert tokens.count_tokens(none, VOCABULARY).count() == 0


def test_long_texts_and_full_memory_count_alike(monkeypatch):
    with open(VOCABULARY, encoding="utf-8") as f:
        vocabulary = f.read()
    counter = tokens.Counter(vocabulary, tokens.whole_tokens(Tokenizer.from_str(vocabulary)))
    text = "Invented wördlings, 12 of them;  and   then\n\n some more. " * 50
    want = counter._library(text)
    monkeypatch.setattr(tokens, "LONG", 10)
    monkeypatch.setattr(tokens, "REMEMBERED", len(counter.whole) + 2)
    assert counter.count(text) == want


@pytest.mark.parametrize(("text", "licence"), [
    (licences._MIT, "MIT"), ("MIT LICENSE\n\nCopyright (c) 2019 A. Person\n\n" + licences._MIT.upper().replace("\n", " "), "MIT"),
    (licences._ISC.replace("fee", "fee "), "ISC"), ("Licenced under the Apache Licence, Version 2.0", "Apache-2.0"),
    (licences._MIT.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS").replace("charge,", "charge"), "MIT"),
    (licences._MIT + " Not.", None), ("", None), (None, None), ("(c) 2001 X", None)])
def test_whole_licence_texts(spark, text, licence):
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r["licence"] for r in got] == [licence]


def test_licence_lines(docs, messy, none, spark):
    rows = [(1, "Prose here.\nReleased under the MIT License.\n\nLicensed under CC BY 4.0\nReleased under the MIT Licence"), (1, "Prose"), (2, "x\n(c) 2020\ny")]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["line_licences"], r["n_lines"]) for r in got if r["line_licences"]) == [(1, "CC-BY-4.0,MIT", 4)]
    assert licences.scan(docs).count() == len(messy) and licences.scan(none).count() == 0
    own = licences.known_digests(spark, [("own", "Prose")])
    assert [r["licence"] for r in licences.scan(spark.createDataFrame(rows[1:2], "doc_id long, text string"), own).collect()] == ["own"]


def _passages(docs, items):
    """Plain version: every item against every alignment."""
    out = set()
    for i, t in docs:
        w = decontaminate.tokens((t or "").encode())
        for k, b in items:
            x = decontaminate.tokens((b or "").encode())
            if len(x) < decontaminate.LEAST:
                continue
            need = 0.8
            size = min(decontaminate.STRETCH, len(x))
            for o in range(-len(x) + size, len(w) - size + 1):
                same = [w[o + j] == x[j] if 0 <= o + j < len(w) else None for j in range(len(x))]
                if any(None not in s and sum(s) >= need * size for s in (same[j:j + size] for j in range(len(x) - size + 1))):
                    out.add((i, k))
    return out


def test_short_masks_leave_out_all_that_may_differ():
    from itertools import combinations
    for n in range(decontaminate.LEAST, decontaminate.STRETCH):
        masks, differ = decontaminate.short_masks(n), n * (100 - decontaminate.SAME) // 100
        assert all(len(m) == n and m.count("1") >= 4 for m in masks)
        assert all(any(all(m[i] == "0" for i in some) for m in masks) for some in combinations(range(n), differ))


def test_passages_with_substitutions(spark):
    import random
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([4, 5, 11, 13, 14, 20, 35, 59])] + [(8, None), (9, ""), (None, "aa bb cc dd ee ff")]
    docs = [(0, None), (1, "")]
    for k, text in items[:8]:
        for changes in (0, 1, 2, 4):
            w = text.split()
            for j in rnd.sample(range(len(w)), min(changes, len(w))):
                w[j] = word()
            lead = " ".join(word() for _ in range(rnd.randrange(30)))
            docs.append((len(docs), f"{lead} {' '.join(w).title()}, {word()}!"))
        docs.append((len(docs), " ".join(text.split()[:len(text.split()) // 2])))
    docs += [(len(docs), " ".join(word() for _ in range(400))), (None, items[6][1]), docs[-1]]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)),
                             spark.createDataFrame(items, "item_id long, text string"))
    want = _passages(docs, items)
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found <= want
    exact = {(i, k) for i, t in docs for k, b in items if b and len(decontaminate.tokens(b.encode())) >= 5
             and " ".join(decontaminate.tokens(b.encode())) in " ".join(decontaminate.tokens((t or "").encode()))}
    assert exact <= found
    assert len(found) >= 0.95 * len(want)
    split = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=40)
    assert sorted(map(str, split.collect())) == sorted(map(str, got.collect()))


def test_passages_of_messy_rows(docs, none, spark, messy):
    bench = spark.createDataFrame([(1, messy[11][1].split("\n")[0]), (2, "one two three")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find(docs, bench).collect()} == {9, 10}
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(docs, bench.where("item_id = 9")).count() == 0


def test_patterns_of_everyday_prose_are_ruled_out_by_a_share_of_the_texts(spark):
    """What so many fillers rule out is not counted any further; a pattern that may be trusted is counted over all texts."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(i, f"zig call me x{letters(i)}" + (f" go send to y{letters(i)}" if i % 600 == 0 else "")) for i in range(3000)]
    texts = spark.createDataFrame(rows, "i long, text string").select(F.xxhash64("i").alias("key"), "text")
    h = lambda w: np.array([xxh64_intdigest(w)], np.uint64)
    common, rare = (int(pii._left(h(a), h(b)).view(np.int64)[0]) for a, b in ((b"call", b"me"), (b"send", b"to")))
    patterns = spark.createDataFrame([(common, 4, 0), (rare, 4, 0), (1, 1, 9)], "pattern long, instances long, beside long")
    got = {r["pattern"]: r["n"] for r in pii.prose_met(texts, patterns, 0.8).collect()}
    assert got.keys() == {common, rare} and got[rare] == 5
    assert 6 < got[common] < 300
