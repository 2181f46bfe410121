import random

import numpy as np
import pytest

from siltstone.llm import words as W
from siltstone.llm.alignment import GAP, MATCH, MISMATCH, banded, plain_words, smith_waterman
from siltstone.llm.decontaminate import contaminated
from siltstone.llm.htmltext import extract, main_text
from siltstone.llm.langid import RankOrder, fit_profiles, gram_counts, identify
from siltstone.llm.licenses import TEMPLATES, scan_licenses
from tests.llm.conftest import prose


def test_words_and_windows():
    import pyarrow as pa

    texts = ["ab  c\n", None, "", "é x y", "　 z", "q"]
    data, off = W.text_bytes(pa.array(texts))
    starts, ends, word_off = W.word_spans(data, off)
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert got == ["ab", "c", "é x", "y", "　", "z", "q"] and word_off.tolist() == [0, 2, 2, 2, 4, 6, 7]
    hashes = W.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == 7
    for size in (1, 2, 3, 5, 7):
        windows = W.window_hashes(np.concatenate([hashes, hashes]), size)
        assert len(windows) == 15 - size and windows[0] == windows[7] and (size == 1 or windows[0] != windows[1])
    assert len(W.window_hashes(hashes, 8)) == 0


def grams_by_hand(text):
    out = {}
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = " ".join(low.split()) + " "
    if low[:1] != " " or True:
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != " ":
                    out[g] = out.get(g, 0) + 1
    return out


def test_gram_counts_by_hand():
    texts = ["Ab ab, cab", "éÉ", "x"]
    for text, (grams, counts) in zip(texts, gram_counts(texts), strict=True):
        want = grams_by_hand(text)
        code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in want.items()}


def test_language_id(spark, documents, awkward):
    rng = random.Random(1)
    kinds = {"aa": ["kata", "tak", "akat"], "bb": ["sero", "ores", "reso"]}
    train = documents([(i, " ".join(rng.choice(kinds[k]) for _ in range(30)), (k, "s")) for i, k in enumerate(["aa", "bb"] * 10)] + [(99, None, ("aa", "s")), (98, "tak", (None, "s"))])
    profiles = fit_profiles(train)
    assert sorted(profiles) == ["aa", "bb"]
    df = documents([*awkward, (500, "tak akat"), (501, "reso 12"), (502, "123 !")], clashing=True)
    got = identify(df, profiles)
    assert got.columns == [*df.columns, "lang_pred", "score"]
    rows = got.collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert len(rows) == len(awkward) + 3 and by[500][0] == "aa" and by[501][0] == "bb"
    assert by[1] == by[2] == by[3] == by[502] == ("und", 0.0) and all(0 <= r.score <= 1 for r in rows)
    assert fit_profiles(documents([])) == {} and RankOrder({}).score(np.array([1]), np.array([1])) == ("und", 0.0)
    assert identify(documents([]), profiles).collect() == []


def test_predictions_against_brute_force(spark, documents, awkward):
    """Profiles and out-of-place distances counted by hand over dictionaries."""
    rng = random.Random(11)
    kinds = {"xx": ["lorna", "narol", "olan"], "yy": ["kishu", "shuki", "huik"], "zz": ["lorki", "nashu", "okil"]}
    train = [(i, " ".join(rng.choice(kinds[k]) for _ in range(25)), (k, "s")) for i, k in enumerate(sorted(kinds) * 8)]
    tested = [(100 + i, " ".join(rng.choice(kinds[k] + ["é1", "Zw"]) for _ in range(rng.randrange(1, 30)))) for i, k in enumerate(sorted(kinds) * 10)] + awkward

    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - k)) for k, c in enumerate(g))

    def ranked(texts, top):
        total = {}
        for t in texts:
            for g, n in (grams_by_hand(t) if any(c.isalpha() for c in t) else {}).items():
                total[g] = total.get(g, 0) + n
        return [code(g) for g in sorted(total, key=lambda g: (-total[g], code(g)))[:top]]

    plain = {k: ranked([t for _, t, (own, _) in train if own == k], 50) for k in kinds}
    profiles = fit_profiles(documents(train), profile=50)
    assert profiles == plain
    got = {}
    for r in identify(documents(tested), profiles, document_grams=40).collect():
        got.setdefault((r.doc_id, r.text), (r.lang_pred, round(r.score, 9)))
    for i, t in tested:
        own = ranked([t or ""], 40)
        if not own:
            assert got[i, t] == ("und", 0.0)
            continue
        worst = max(map(len, plain.values()))
        away = {k: sum(min(abs(p.index(g) - n), worst) if g in p else worst for n, g in enumerate(own)) for k, p in plain.items()}
        best = min(sorted(away), key=away.get)
        assert got[i, t] == (best, round(1 - away[best] / (worst * len(own)), 9)), (i, t)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class="sidebar">Side text that is rather long and goes on and on</div><div class="cookie-notice">We use cookies</div><!-- c -->
<article><h1>Head &amp; more</h1><p>First   para<br>next line</p><script>var x="</p><p>no";</script><div class="ad">Buy now</div><p>Se<b>con</b>d &#233;&nbsp;x</p>
<form><input value=q><label>Mail</label></form><section id="comments"><p>Reader says hello</p></section></article>
<aside>More</aside><footer>&copy; 2000</footer></body></html>"""


def test_main_text_of_an_article():
    assert main_text(PAGE) == "Head & more First para next line Second é x"
    assert main_text(None) == main_text("") == main_text("<nav>x</nav><script>y</script>") == main_text("<!-- ") == ""
    assert main_text("plain &lt;text&gt;\n only") == "plain <text> only"
    assert main_text("<article><p><b>Open <br><p>Two</article><footer>f</footer>") == "Open Two"


def test_main_text_by_line_blocks():
    body = "".join(f"<p>{prose(k, 40)}</p>" for k in range(4))
    page = f"<body><div class=menu><a>One</a></div><div><a href=x>Link one</a></div><div class='ads'>Ad</div><div id=main>{body}</div><div class=related>Rel</div><div>Short</div></body>"
    assert main_text(page) == " ".join(prose(k, 40) for k in range(4))


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, None, "y"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    rows = extract(df).collect()
    assert extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 0), (1, 0), (1, len(main_text(PAGE)))]
    assert extract(df.limit(0)).collect() == []


def brute_local(q, t):
    best, score = 0, [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (MATCH if q[i - 1] == t[j - 1] else MISMATCH), score[i - 1][j] + GAP, score[i][j - 1] + GAP)
            best = max(best, score[i][j])
    return best


def test_alignments_against_brute_force():
    rng = random.Random(4)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(1, 14))], [rng.choice("abc") for _ in range(rng.randrange(1, 25))]) for _ in range(60)]
    arrays = [tuple(np.array([ord(c) for c in x], dtype=np.uint64) for x in p) for p in pairs]
    got = list(smith_waterman([a for a, _ in arrays], [b for _, b in arrays]))
    for (q, t), (qa, ta), (score, start, end) in zip(pairs, arrays, got, strict=True):
        assert score == brute_local(q, t) == banded(qa, ta, 0, 40)[3]
        assert brute_local(q, t[start:end]) == score and 0 <= start <= end <= len(t)
    q = np.arange(1, 9, dtype=np.uint64)
    assert banded(q, np.concatenate([q + np.uint64(50), q, q]), 8, 2)[:3] == (8, 8, 16)


def test_contamination(spark, documents, awkward):
    item = prose(21, 24).split()
    edited = [w if k % 5 else "zzz" for k, w in enumerate(item)]
    dropped = [w for k, w in enumerate(item) if k % 6]
    pad = lambda words, s: f"{prose(s, 80)} {' '.join(words)} {prose(s + 1, 30)}"
    rows = [*awkward, (600, pad(item, 50)), (601, pad([w.upper() + "," for w in item], 52)), (602, pad(edited, 54)), (603, pad(dropped, 56)), (604, pad(item[:5], 58)), (605, prose(60, 300)), (606, " ".join(item)), (606, " ".join(item))]
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, ""), (10, "two words"), (11, prose(31, 40))], "item_id long, text string")
    for block in (20_000, 1):
        got = contaminated(documents(rows, clashing=True), items, block_items=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(600, 7), (601, 7), (602, 7), (603, 7), (606, 7), (606, 7)]
        by = {r.doc_id: r for r in got}
        assert by[600].score == by[601].score == 1.0 and (by[600].start, by[600].end) == (80, 104) and 0.5 <= by[602].score < 1
    assert contaminated(documents([]), items).collect() == [] and contaminated(documents(rows), items.limit(0)).collect() == []


def test_contamination_finds_all_edited_copies(spark, documents):
    """Only edited copies (a fifth to half of the words), held against alignments with the whole document."""
    rng = random.Random(8)
    texts = {k: prose(900 + k, rng.choice([3, 5, 9, 15, 30, 50])).split() for k in range(24)}
    cut = {k: [w for n, w in enumerate(words) if n % 3 != 2] for k, words in texts.items()}  # no three words in a row stay
    spaced = {k: [x for w in words for x in (w, "zz")] for k, words in texts.items()}  # nor two
    rows = []
    for k, words in texts.items():
        copies = [cut[k], spaced[k], [w for n, w in enumerate(words) for w in ([w, "zz"] if n % 3 == 2 else [w])], ["zz" if n % 3 == 2 else w for n, w in enumerate(words)]]
        for rate in (0.2, 0.25, 0.3, 0.4, 0.5):
            copies.append([x for w in words for x in ([w] if rng.random() >= rate else rng.choice([["zz"], [], [w, "yy"], ["yy", rng.choice(words)]]))])
        rows += [(100 * k + c, f"{prose(c, 40)} {' '.join(copy)} {prose(c + 1, 20)}") for c, copy in enumerate(copies)]
    items = spark.createDataFrame([(k, " ".join(words)) for k, words in texts.items()], "item_id long, text string")
    hashed = lambda t: plain_words(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0]
    pairs = [(d, k, hashed(" ".join(words)), hashed(t)) for d, t in rows for k, words in texts.items()]
    scores = smith_waterman([x[2] for x in pairs], [x[3] for x in pairs])
    want = {(d, k): s / (MATCH * len(q)) for (d, k, q, _), (s, _, _) in zip(pairs, scores, strict=True) if s >= MATCH * len(q) * 0.5}
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(documents(rows), items).collect()}
    assert got == want and len({d for d, _ in want}) > 150


def test_contamination_blocks_and_hot_documents(spark, documents, monkeypatch):
    """One row an item, however often a document holds it; blocks end by bytes as well."""
    from siltstone.llm import decontaminate

    items = [(k, prose(700 + k, 20)) for k in range(12)]
    hot = " ".join(items[k % 3][1] for k in range(600))
    rows = [(1, hot), (2, f"{prose(1, 30)} {items[5][1]} {prose(2, 30)}"), (3, prose(3, 9000))]
    table = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((r.doc_id, r.item_id, r.score, r.start, r.end) for r in contaminated(documents(rows), table).collect())
    assert [x[:2] for x in whole] == [(1, 0), (1, 1), (1, 2), (2, 5)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 250)
    assert len(list(decontaminate._blocks(table.select("item_id", "text").withColumnRenamed("item_id", "item"), 100))) > 4
    assert sorted((r.doc_id, r.item_id, r.score, r.start, r.end) for r in contaminated(documents(rows), table).collect()) == whole


def test_licenses(spark, documents, awkward):
    mit = dict(TEMPLATES[:1])["MIT"]
    lines = {700: "Released under the MIT License.", 701: "Licensed under the Apache License, Version 2.0.", 702: "This work is licensed under the GNU General Public License, version 3.", 703: "Licensed under CC BY-NC 4.0.", 704: mit.replace("furnished", "handed"), 705: " ".join(mit.split()[:20])}
    rows = [*awkward, *((k, f"{prose(k, 30)}\n{v}\n{prose(k + 50, 30)}") for k, v in lines.items()), (706, prose(3, 400) + " released under pressure")]
    got = {r.doc_id: r for r in scan_licenses(documents(rows, clashing=True)).collect()}
    assert {k: r.license for k, r in got.items()} == {700: "MIT", 701: "Apache-2.0", 702: "GPL-3.0", 703: "CC-BY-NC-4.0", 704: "MIT"}
    texts = dict(rows)
    assert texts[700].encode()[got[700].start_byte : got[700].end_byte].decode() == "Released under the MIT License"
    assert got[701].coverage == 1.0 and 0.95 < got[704].coverage < 1
    twice = documents([(1, lines[700] + " and " + lines[701]), (None, lines[703])])
    assert sorted((r.doc_id or 0, r.license) for r in scan_licenses(twice).collect()) == [(0, "CC-BY-NC-4.0"), (1, "Apache-2.0"), (1, "MIT")]
    assert scan_licenses(documents([])).collect() == []


def test_plain_words_ignore_punctuation():
    raw = np.frombuffer(b"Ab, (ab) x-y", dtype=np.uint8)
    hashes, starts, ends, _ = plain_words(raw, np.array([0, len(raw)]))
    assert hashes[0] == hashes[1] and [raw[a:b].tobytes() for a, b in zip(starts, ends)] == [b"Ab", b"ab", b"x", b"y"]


@pytest.mark.parametrize("size", [1, 3])
def test_empty_arrays(size):
    index, counts = W.valid_windows(np.array([0, 0, 0]), size)
    assert len(index) == 0 and counts.tolist() == [0, 0]
