import hashlib
import random
import zlib

from weftline.llm import lines

from .corpora import edge_rows, empty, frame

BLANK = " \t\n\x0b\x0c\r"


def plain(rows):
    holders = {}
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    for d, ls in split:
        for x in ls:
            if d is not None and len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(d)
    out = []
    for d, ls in split:
        gone = [d is not None and len(h := holders.get(key(x), ())) >= 5 and d != max(h) for x in ls]
        kept = "\n".join(x for x, g in zip(ls, gone, strict=True) if not g)
        out.append((d, len(ls), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    rows = lines.dedup_lines(df, counts=("lines", "dropped")).selectExpr("doc_id", "lines", "dropped", "sha2(text, 256)").collect()
    return sorted(map(tuple, rows), key=str)


def test_matches_brute_force_with_hot_lines(spark):
    rng = random.Random(2)
    pool = [f"{i} a line that is surely longer than forty code points, é {i}" for i in range(30)] + [f"short {i}" for i in range(10)]
    rows = []
    for d in range(400):
        ls = [rng.choice(pool) for _ in range(rng.randrange(6))] + ([pool[0].upper() + "\r"] if d % 3 else [])
        rng.shuffle(ls)
        rows.append((d * 13 % 401, "\n".join(ls)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(df) == plain(rows)


def test_edge_cases(spark):
    assert got(frame(spark, edge_rows())) == plain([(r[0], r[1]) for r in edge_rows()])
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_bitmaps_and_other_columns_stay(spark):
    df = frame(spark, edge_rows())
    assert lines.dedup_lines(df).schema.names == df.columns
    dropped = {d: n for d, _, n, _ in plain([(r[0], r[1]) for r in edge_rows()])}
    maps = lines.keep_bitmaps(df).collect()
    assert maps and {r.doc_id for r in maps} == {d for d, n in dropped.items() if n}
    for r in maps:
        bits = zlib.decompress(r.keep)
        assert 8 * len(bits) - sum(b.bit_count() for b in bits) == dropped[r.doc_id]


def test_rows_of_one_doc_id_lose_their_own_lines(spark):
    rng = random.Random(7)
    pool = [f"{i} a line that many of the rows share, longer than forty code points {i}" for i in range(6)]
    rows = []
    for d in range(60):
        for _ in range(1 + d % 3):
            own = [f"own line {rng.randrange(10**9)} of this row, unique in the corpus, long enough to have a key" for _ in range(rng.randrange(5))]
            ls = own + rng.sample(pool, rng.randrange(4))
            rng.shuffle(ls)
            rows.append((d if d % 7 else None, "\n".join(ls)))
    rows += [rows[-1], rows[-1]]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain(rows)


def test_columns_with_any_name_stay(spark):
    df = frame(spark, edge_rows()).selectExpr("text", "doc_id", "h AS `keep`", "lang AS `c0`", "source AS `own_id`", "score AS `__gone`", "n_chars AS `__n_lines`", "h AS `a.b`")
    out = lines.dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    want = sorted(map(str, df.select("doc_id", "`keep`", "c0", "own_id", "__gone", "__n_lines", "`a.b`").collect()))
    assert sorted(map(str, out.select("doc_id", "`keep`", "c0", "own_id", "__gone", "__n_lines", "`a.b`").collect())) == want


def test_query_gives_what_its_sql_gives(spark, data):
    import duckdb

    from weftline.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op6_line_dedup"]).fetchall()
    out = queries.op6_line_dedup(spark, data).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, out)) == sorted(want)
