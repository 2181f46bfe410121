import re
from collections import Counter

from siltstone.llm.line_dedup import dedup_lines
from siltstone.llm.mixing import mix
from siltstone.llm.quality import quality
from pyspark.sql import functions as F
from tests.llm.conftest import prose


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_quality_counts_against_brute_force(spark, documents, awkward):
    rows = awkward + [(300, "a b c a b c a\nx\nx \nx\n\n"), (301, "Buy # now | $ & % <b> *"), (302, ("one two three four five. " * 30).strip())]
    got = quality(documents(rows, clashing=True)).collect()
    assert len(got) == len(rows)

    def want(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        often = Counter(win)
        twice = {k + d for k, x in enumerate(win) if often[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice), failed

    found = sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert found == sorted(((i or -1), *want(t)) for i, t in rows)
    assert quality(documents([])).collect() == []


def test_quality_verdicts(spark, documents):
    clean = "\n".join(" ".join(prose(s, 12).split()).capitalize() + "." for s in range(8))
    rows = [(1, clean), (2, "\n".join(x.replace(" ", " | ") for x in clean.split("\n"))), (3, clean.replace(" ", "### ")), (4, clean.upper()), (5, clean + "\nPrivacy policy\nHome | News | About"), (6, clean.replace(".", ""))]
    got = {r.doc_id: r for r in quality(documents(rows)).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, False, False, False, True, False]
    assert got[1].clean_text == clean and got[5].clean_text == clean and got[1].lost_chars == 0


def test_line_rules_against_patterns(spark):
    """The rules as the fixed patterns state them, over random lines of marks, words and blanks."""
    import random

    from siltstone.llm import quality as rules

    def fails(line):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", line))
        unended = not re.search(rules.LINE_END.replace("$", r"\Z"), line) and (words < 10 or not re.search(rules.SENTENCE_MARK, line))
        symbols = 4 * len(re.findall(r"[#*$%&|<>]", line)) > words
        shouted = 4 * len(re.findall(rules.SHOUTED_MARK, line)) > words or (words >= 5 and any(c.isupper() for c in line) and not any(c.islower() for c in line))
        menu = len(re.findall(rules.SEPARATOR, line)) >= 2 and 5 * len(re.findall(rules.SEPARATOR, line)) >= words
        return bool(unended or symbols or shouted or menu or words <= 25 and re.search(rules.BOILERPLATE, line))

    rng = random.Random(9)
    pieces = ["word", "Word", "WORD", "a", "|", "»", "!!", "?!", ".", ".)", '."', "end.", "end!”", "#", "$", "&", "  ", "\t", "Privacy policy", "log in", "read more", "cookies", "…", "12"]
    lines = [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 16))) for _ in range(1500)]
    lines += [" ".join(["word"] * n) + t for n in (4, 9, 10, 24, 25, 26) for t in ("", ".", " Privacy policy", ". more", ' ."', '. "')]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r.i: r.f for r in df.select("i", rules.line_fails(F.col("line")).alias("f")).collect()}
    assert [got[i] for i in range(len(lines))] == [fails(x) for x in lines]


def brute_lines(rows, length=3, long_words=50):
    """Runs of ``length`` lines, and shorter ones of ``long_words`` words."""
    lines = {i: [(n, x.strip(" \t\n\x0b\x0c\r")) for n, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")] for i, t in rows}
    words = lambda run: sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in run)

    def runs(own):
        for size in range(1, length + 1):
            for p in range(len(own) - size + 1):
                run = tuple(x for _, x in own[p : p + size])
                if size == length or words(run) >= long_words:
                    yield p, run

    first, out = {}, {}
    for i in sorted(lines):
        for p, run in sorted(runs(lines[i]), key=lambda x: x[0]):
            first.setdefault(run, (i, p))
    for i, t in rows:
        own, gone = lines[i], set()
        for p, run in runs(own):
            if first[run] != (i, p):
                gone |= {n for n, _ in own[p : p + len(run)]}
        out[i] = (len(own), len(gone), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone))
    return out


def test_long_lines_and_hot_keys_against_brute_force(spark, documents, monkeypatch):
    """Lines of 20 to 70 words that repeat in ones and twos, with every key counted as hot."""
    import random

    from siltstone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 1)
    rng = random.Random(6)
    pool = [prose(k, n) for k, n in enumerate([20, 30, 35, 49, 50, 70, 5])]
    rows = [(i, rng.choice(["\n", "\n\n"]).join(rng.choice([*pool, prose(1000 + i, 9)]) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    rows += [(200 + i, "\n".join([pool[5], pool[6]])) for i in range(150)]
    got = dedup_lines(documents(rows).repartition(4)).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got} == brute_lines(rows)


def test_line_runs_against_brute_force(spark, documents):
    import random

    rng = random.Random(3)
    rows = [(i, rng.choice(["\n", "\n\n", " \n"]).join(rng.choice("abcd") for _ in range(rng.randrange(14)))) for i in rng.sample(range(-20, 300), 60)]
    df = dedup_lines(documents(rows).repartition(4))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in df.collect()} == brute_lines(rows)
    assert not re.search("Python|Pandas|Arrow", plan(df))


def test_line_dedup_awkward_rows(spark, documents, awkward):
    text = "a b\nc d\ne f\ng h"
    rows = [*awkward, (400, text), (401, text), (401, text), (402, "top\n" + text + "\n\nend"), (None, text)]
    df = documents(rows, clashing=True)
    got = dedup_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_removed", "removed_lines"]
    out = got.collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_lines, r.n_removed, r.text))
    assert by[400] == [(4, 0, text)] and by[401] == [(4, 4, "")] * 2 and by[402] == [(6, 4, "top\n\nend")] and (4, 4, "") in by[None]
    assert by[1] == [(0, 0, None)] and by[2] == [(0, 0, "")]
    assert dedup_lines(documents([])).collect() == []


def test_line_dedup_finds_long_passages_on_few_lines(spark, documents):
    long, half, short = prose(900, 60), [prose(901, 30), prose(902, 25)], prose(903, 49)
    rows = [
        (1, f"top\n{long}\n" + "\n".join(half) + f"\nmid\n{short}\nend"),
        (2, f" {long} "),  # one line, one document
        (3, f"other\n{half[0]}\n\n{half[1]}\nmore"),
        (4, f"{short}\n{half[0]}\nfew\n{half[1]}"),  # each of fewer than 50 words alone
        (5, f"{long}\nx\n{long}"),
        (6, f"top\n{long}\nlast"),  # a short line beside a long one
    ]
    got = {r.doc_id: (r.n_removed, r.text) for r in dedup_lines(documents(rows).repartition(3)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, ""), 3: (2, "other\n\nmore"), 4: (0, rows[3][1]), 5: (2, "x"), 6: (2, "last")}
    assert all(r.n_removed == 0 for r in dedup_lines(documents(rows), long_words=None).collect() if r.doc_id != 6)


def test_mixing_budgets(spark, documents):
    rows = []
    for k in range(400):
        source = ["a", "b", "c", "d"][k % 4 if k % 8 else 3]
        rows.append((k, prose(k, 10 + k % 7), (None if k % 97 == 0 else "en" if k % 3 else "de", source)))
    rows += [(1000, None), (1001, ""), (None, "w " * 5), (None, "w " * 5)]
    df = documents(rows, clashing=True)
    path = {"domain": F.expr("case when source in ('a', 'b') then 'web' else 'books' end"), "lang": F.col("lang"), "source": F.col("source")}
    total = 3000
    got = mix(df, path, {("web",): 3, ("books",): 1, ("web", "en"): 2}, total, max_epochs=2, seed="s")
    assert got.columns == ["doc_id", "domain", "lang", "source", "epoch", "tokens"]
    out = got.collect()
    spent = {}
    for r in out:
        spent[r.domain] = spent.get(r.domain, 0) + r.tokens
    assert spent["web"] <= 2250 and spent["books"] <= 750 and sum(spent.values()) > 0.95 * total
    assert sorted((r.doc_id or -1, r.epoch, r.tokens) for r in out) == sorted((r.doc_id or -1, r.epoch, r.tokens) for r in mix(df.repartition(7), path, {("web",): 3, ("books",): 1, ("web", "en"): 2}, total, max_epochs=2, seed="s").collect())
    everything = mix(df, path, {}, 10**9, max_epochs=2, seed="s").collect()
    assert len(everything) == 2 * sum(1 for x in rows if x[1] and x[1].strip())
    assert mix(documents([]), path, {}, 100).collect() == []


def test_mixing_passes_shortage_to_siblings_first(spark, documents):
    rows = [(k, "w " * 10, ("en", s)) for s, n in (("small", 1), ("big", 40), ("other", 40)) for k in range(1000 * len(s), 1000 * len(s) + n)]
    path = {"domain": F.expr("case when source = 'other' then 'y' else 'x' end"), "source": F.col("source")}
    got = mix(documents(rows), path, {}, 200, max_epochs=1).groupBy("source").agg(F.sum("tokens").alias("n")).collect()
    assert {r.source: r.n for r in got} == {"small": 10, "big": 90, "other": 100}


def test_mixing_of_one_id_and_long_texts(spark, documents, monkeypatch):
    """A third of the rows share an id, one text is very long; the leaf is filled all the same, plan broadcast or not."""
    from siltstone.llm import common, mixing

    rows = [(7, prose(k % 3, 10 + k % 3), ("en", "a")) for k in range(300)] + [(1000 + k, prose(k, 12), ("en", "a")) for k in range(600)] + [(1, "w " * 40_000, ("en", "b"))]
    path = {"lang": F.col("lang"), "source": F.col("source")}
    take = lambda total: mix(documents(rows), path, {("en", "b"): 1, ("en", "a"): 1}, total, max_epochs=2, seed="q").collect()
    out = take(14_000)
    spent = {s: sum(r.tokens for r in out if r.source == s) for s in ("a", "b")}
    assert spent["b"] == 0 and 7000 - 13 < spent["a"] <= 7000  # one document of 40,000 words is more than its share
    assert {r.source for r in take(200_000)} == {"a", "b"}
    epochs = {}
    for r in out:
        epochs[r.doc_id, r.tokens, r.epoch] = epochs.get((r.doc_id, r.tokens, r.epoch), 0) + 1
    assert max(n for (i, _, _), n in epochs.items() if i != 7) == 1 and all(n <= 100 for n in epochs.values())
    monkeypatch.setattr(mixing, "PLAN_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    assert sorted(map(str, take(14_000))) == sorted(map(str, out))
