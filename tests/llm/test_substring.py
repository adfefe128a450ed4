import random
import re
import zlib

from weftline.llm import substring

from .corpora import edge_rows, empty, frame


def cut(text):
    """(start, end, words) of sentences, the long ones cut after the word of least hash of every twelve."""
    out = []
    for m in re.finditer(r"[^.!?\n]*(?:[.!?]+|\n|$)[^\S\n]*", text):
        if m.end() == m.start():
            continue
        ends = []
        if len(re.findall(r"[^\S\n]", m.group())) >= 16:
            words = [(w.end(), zlib.crc32(w[1].lower().encode())) for w in re.finditer(r"(\S+)\s*", m.group())]
            chosen = None
            for i in range(12, len(words) + 1):
                own = range(i - 12, i)
                least = min(words[k][1] for k in own)
                if chosen not in own or words[chosen][1] != least:
                    chosen = max(k for k in own if words[k][1] == least)
                end = m.start() + words[chosen][0]
                if end not in ends and end < m.end():
                    ends.append(end)
        for a, b in zip([m.start(), *ends], [*ends, m.end()], strict=True):
            out.append((a, b, re.findall(r"\w+", text[a:b].lower())))
    return out


def plain(rows, least=25):
    out = []
    split = []
    for d, t in rows:
        split.append((d, t or "", cut(t or "")))
    runs = []
    for row, (d, _, ss) in enumerate(split):
        if d is None:
            continue
        n = len(ss)
        for i in range(n):
            for j in range(i + 1, n + 1):
                if not ss[i][2] or not ss[j - 1][2]:
                    continue
                size = sum(len(w) for _, _, w in ss[i:j])
                ahead = size >= least and sum(len(w) for _, _, w in ss[i : j - 1]) < least
                behind = size >= least and sum(len(w) for _, _, w in ss[i + 1 : j]) < least
                if ahead or behind:
                    runs.append((row, d, i, j, tuple(x for _, _, w in ss[i:j] for x in w)))
    home, own = {}, {}
    for row, d, i, _, key in runs:
        home[key] = min(home.get(key, d), d)
        own[row, key] = min(own.get((row, key), i), i)
    gone = {}
    for row, d, i, j, key in runs:
        if d > home[key] or i > own[row, key]:
            gone.setdefault(row, set()).update(range(i, j))
    for row, (d, t, ss) in enumerate(split):
        drop = gone.get(row, set())
        out.append((d, len(drop), "".join(t[s:e] for k, (s, e, _) in enumerate(ss) if k not in drop)))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, substring.dedup_substrings(df).select("doc_id", "n_removed", "kept").collect()), key=str)


def sentence(rng, n):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(90)}" for _ in range(n)).capitalize() + rng.choice(".!?")


def test_matches_brute_force(spark):
    rng = random.Random(11)
    passages = [" ".join(sentence(rng, rng.randrange(2, 20)) for _ in range(rng.randrange(3, 8))) for _ in range(6)]
    rows = []
    for d in range(90):
        parts = [sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(8))]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((d * 31 % 97, rng.choice([" ", "\n"]).join(parts)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_long_passages_go_from_all_but_the_first(spark):
    rng = random.Random(12)
    passage = " ".join(sentence(rng, 11) for _ in range(6))  # 66 words
    rows = [(d, f"{sentence(rng, 9)} {passage} {sentence(rng, 9)}") for d in range(20)]
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_removed == 0
    for d in range(1, 20):
        assert out[d].n_removed >= 6 and [rows[d][1][s.start : s.end].strip() for s in out[d].removed] == [passage]


def test_edge_cases(spark):
    short = [(*r[:1], (r[1] or "")[:9000] or r[1], *r[2:]) for r in edge_rows()]  # the plain version takes the cube of a text
    assert got(frame(spark, short)) == plain([(r[0], r[1]) for r in short])
    whole = {r.doc_id: r for r in substring.dedup_substrings(frame(spark, edge_rows())).collect()}
    assert len(whole) == len({r[0] for r in edge_rows()}) and whole[6].n_removed == 0 and whole[7].kept == ""
    assert substring.dedup_substrings(empty(spark)).count() == 0


def test_runs_are_the_shortest_each_way():
    assert substring.runs([10, 10, 10], 25) == [(0, 3)]
    assert substring.runs([], 5) == [] and substring.runs([3], 5) == []


def test_cuts_fall_alike_wherever_a_passage_is(spark):
    rng = random.Random(13)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(120))  # no stops at all
    rows = [(d, " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 40))) + f" {passage} " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(9))) for d in range(12)]
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].n_removed == 0
    for d in range(1, 12):
        gone = " ".join(rows[d][1][s.start : s.end] for s in out[d].removed).split()
        assert len(gone) > 60 and all(w[0] == "p" for w in gone)


def test_any_blank_counts_towards_a_cut(spark):
    rng = random.Random(13)
    words = lambda c, n: [f"{c}{rng.randrange(10**6)}" for _ in range(n)]
    passage = words("p", 120)
    for blank in ("\t", "\u00a0", "\u3000"):
        rows = [(d, blank.join([*words("o", 7 + d), *passage, *words("o", 9)])) for d in range(4)]
        out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert out[0].n_removed == 0
        for d in range(1, 4):
            gone = " ".join(rows[d][1][s.start : s.end] for s in out[d].removed).split()
            assert len(gone) > 60 and all(w[0] == "p" for w in gone)


def test_rows_of_one_doc_id_lose_their_own_runs(spark):
    rng = random.Random(17)
    passages = [" ".join(sentence(rng, rng.randrange(4, 20)) for _ in range(4)) for _ in range(4)]
    rows = []
    for d in range(40):
        for _ in range(1 + d % 3):
            parts = [sentence(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(5))]
            parts += rng.choices(passages, k=rng.randrange(3))
            rng.shuffle(parts)
            rows.append((d if d % 9 else None, " ".join(parts)))
    rows += rows[-2:]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain(rows)


def test_passages_of_just_over_fifty_words_inside_longer_sentences_go(spark):
    rng = random.Random(19)
    words = lambda c, n: [f"{c}{rng.randrange(10**6)}" for _ in range(n)]
    rows, passages = [], []
    for k in range(60):  # no stop anywhere, so that only cuts tell where a passage begins
        passages.append(words("p", 51))
        rows += [(2 * k + i, " ".join([*words("o", rng.randrange(20, 60)), *passages[-1], *words("o", 30)])) for i in range(2)]
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[2 * k].n_removed == 0 for k in range(60))
    assert all(out[2 * k + 1].n_removed for k in range(60))


def test_one_word_over_and_over_is_a_repeat(spark):
    rows = [(1, "alpha beta " + "foo " * 500), (2, "gamma " + "foo " * 300)]
    out = {r.doc_id: r for r in substring.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].kept.count("foo") <= 60 and out[2].kept.count("foo") <= 30
