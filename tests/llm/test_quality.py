import re
from collections import defaultdict

from boardwise.llm import quality

from .cases import LONG, SCHEMA, TEXTS, by_id, clashing, documents

SPACE = "[\x20\x09-\x0d]+"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, limits=quality.Limits(), cleaned=None):
    """rows: (doc_id, text, source). Verdicts by doc_id; cleaned, if given, takes texts without removed lines."""
    holders, hosts, lines = defaultdict(set), defaultdict(set), {}
    for i, t, host in rows:
        t, host = t or "", host or ""
        lines[i] = [(n, x) for n, raw in enumerate(t.split("\n")) if (x := lower(re.sub(SPACE, " ", raw)).strip(" "))]
        for _, x in lines[i]:
            holders[host, x].add((i, t))
            hosts[host].add(t)
    first = {k: min(i for i, _ in v) for k, v in holders.items() if len({t for _, t in v}) > limits.docs and len({t for _, t in v}) > limits.share * len(hosts[k[0]])}
    out = {}
    for i, t, host in rows:
        t, host = t or "", host or ""
        words = [w for w in re.split(SPACE, t) if w]
        windows = defaultdict(list)
        for k in range(len(words) - 7):
            windows[tuple(words[k : k + 8])].append(k)
        repeat = {p for v in windows.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
        raw = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        gone = sum(len(x.split(" ")) for _, x in lines[i] if first.get((host, x), i) != i)
        failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
        depleted = gone > 0 and (len(words) - gone < limits.words or gone > limits.removed * len(words))
        if cleaned is not None:
            places = {n for n, x in lines[i] if first.get((host, x), i) != i}
            cleaned[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in places)
        out[i] = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(raw) - len(set(raw)), len(repeat), failed, gone, depleted, not failed and not depleted)
    return out


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "depleted", "kept"]


def texts():
    body = lambda k: " ".join(f"w{k}x{j}" for j in range(30))
    shared = "Home | About | Contact  us today"
    out = TEXTS + [f"{body(i)}\n{shared}\n a\tfew more words {i}" for i in range(12)] + [f"{shared}\n{shared.upper()} \nown words {i} " + "z " * 9 for i in range(6)]
    out += ["one two three four five six seven eight nine " * 2 + body(77), "a b c d e f g h i a b c d e f g h i " * 4, body(5) + " # $ %% <b> | & *"]
    return out + [out[-4]] * 3


def test_measures_and_verdicts_equal_brute_force(spark):
    docs = clashing(documents(spark, texts()))
    for limits in (quality.Limits(), quality.Limits(docs=2, share=0.0), quality.Limits(docs=0, share=0.2, removed=0.1)):
        got = by_id(quality.judge(docs, "doc_id", limits=limits))
        want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], limits)
        assert {i: tuple(r[n] for n in NAMES) for i, r in got.items()} == want
    assert any(w[7] for w in want.values())


def test_lines_are_taken_out_but_for_the_first_document(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nshared line\nend {i}", "en", "s", None) for i in range(4)] + [(9, None, None, None, None)], SCHEMA)
    got = by_id(quality.without_frequent_lines(docs, quality.Limits(docs=2, share=0.0)))
    assert [got[i].text for i in range(4)] == ["own 0\nshared line\nend 0"] + [f"own {i}\nend {i}" for i in (1, 2, 3)]
    assert got[9].text is None
    many = "\n".join(["shared line", "own"] * 30_000)
    docs = spark.createDataFrame([(i, many + f"\n{i}", "en", "s", len(many) + 2) for i in range(3)], SCHEMA)
    got = by_id(quality.without_frequent_lines(docs, quality.Limits(docs=2, share=0.0)))
    assert got[0].text == many + "\n0" and (got[1].text, got[1].n_chars) == ("1", 1)


def test_the_rule_does_not_switch_with_the_size_of_a_host(spark):
    """A line that a tenth of a host's documents share goes at every size, however many copies the host has of another text."""
    for n in (60, 400):
        rows = [(i, f"own words of {i} " * 5 + f"{i}\n" + ("Home | About" if i % 10 == 0 else f"line {i}") + f"\nend {i}", "en", "s", None) for i in range(n)]
        rows += [(10_000 + i, "one text that has many copies", "en", "s", None) for i in range(20 * n)]
        got = by_id(quality.without_frequent_lines(spark.createDataFrame(rows, SCHEMA)))
        assert [i for i in range(n) if "Home" in got[i].text] == [0] and got[10_000].text == got[10_007].text == "one text that has many copies"


def test_repeated_rows_copies_and_an_empty_table(spark):
    rows = [(1, LONG, "en", "s", None)] * 3 + [(i, LONG, "en", "s", None) for i in range(2, 99)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.depleted for r in quality.judge(docs, "doc_id").collect()} == {False}  # copies are one document
    kept = quality.drop_rejected(documents(spark, texts()))
    assert kept.columns == documents(spark).columns and kept.count() == sum(w[8] for w in brute([(r.doc_id, r.text, r.source) for r in documents(spark, texts()).collect()]).values())
    cleaned = quality.keep_and_clean(documents(spark, texts()))
    assert cleaned.columns == kept.columns and {r.doc_id for r in cleaned.collect()} == {r.doc_id for r in kept.collect()}
    assert quality.judge(spark.createDataFrame([], SCHEMA), "doc_id").count() == 0
