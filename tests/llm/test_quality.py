import random
import re

from asofspark.llm import quality

def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_counts_equal_plain_ones(spark):
    rnd = random.Random(11)
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "x " * 9, "x " * 30, ("a b c d e f g h i j\n" * 3), "wörd x 日本 🙂 " * 40, "z" * 50_000, "n | a | v " * 500]
    texts += [" ".join(rnd.choice("abc") + rnd.choice("\n \t") for _ in range(rnd.randrange(60))) for _ in range(150)]
    texts += [" ".join(str(i) for i in range(20_000)) + " 7 8 9 10 11 12 13 14 15"]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, lines string, kept int")
    got = quality.judge(df).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        want = base((texts * 2)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want, (texts * 2)[r.doc_id]
        assert not (r.base_failed and r.kept)


def sentence(seed):
    rnd = random.Random(seed)
    return "Word " + " ".join("".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(3, 8))) for _ in range(16)) + "."


NAV = "home | about | contact | imprint | help | jobs | news | shop | more | all"


def test_lines_are_judged_first(spark):
    rows = [
        (1, "\n".join([sentence(1), sentence(2), NAV])),
        (2, "\n".join([sentence(1), *(" | ".join(f"{w}{i}" for w in NAV.split(" | ")) for i in range(5))])),
        (3, (sentence(3) + " " + sentence(4)).upper()),
        (4, sentence(5) + " " + sentence(6) + " Please see our Privacy Policy."),
        (5, sentence(7) + "\n" + sentence(8) + "\n\n" + sentence(9) + "\n" + sentence(10) + "\n" + sentence(11) + "\n" + sentence(12) + "\n" + sentence(13) + "\n" + sentence(7)),
    ]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and "|" not in got[1].kept_text and got[1].kept_text.startswith(sentence(1))
    assert not any(got[i].kept or got[i].base_failed for i in (2, 3, 4))
    assert got[5].kept and got[5].kept_text.count(sentence(7)) == 1


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_navigation_is_no_text(spark):
    """A document of menu entries and category lines is kept out; a short list within prose stays."""
    entries = "\n".join(f"Menu entry {i}" for i in range(14)) + "\n" + "\n".join(f"Category {c}" for c in "abcdefg")
    prose = "\n".join(" ".join(f"wort{chr(97 + i)}{chr(97 + k)}" for k in range(12)) + "." for i in range(8))
    rows = [(1, entries), (2, f"{prose}\nOne\nTwo\n{prose.replace('wort', 'mot')}"), (3, f"{entries}\n{prose}"), (4, None), (5, "")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {d: r.kept for d, r in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert got[1].kept_text == "" and "One\nTwo" in got[2].kept_text and got[3].kept_text == prose


def test_boilerplate_is_learned_by_neighbourhoods_not_by_copies(spark):
    say = lambda i, k: " ".join(f"wort{i}x{k}y{j}" for j in range(8)) + "."
    line = "Alle Rechte vorbehalten durch den Verlag."
    rows = [(i, f"{say(i, 1)}\n{line}\n{say(i, 2)}\n{say(i, 3)}") for i in range(quality.LEAST_CONTEXTS)]
    rows += [(1000 + i, "\n".join(say("kopie", k) for k in range(5))) for i in range(60)]
    got = {r.doc_id: r.kept_text for r in quality.judge(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert all(line not in got[i] and say(i, 2) in got[i] for i in range(quality.LEAST_CONTEXTS))
    assert all(len(got[1000 + i].split("\n")) == 5 for i in range(60))
    few = quality.judge(spark.createDataFrame(rows[1 : quality.LEAST_CONTEXTS], "doc_id int, text string"))
    assert all(line in r.kept_text for r in few.collect())
