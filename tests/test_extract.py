from weftline.sources import extract as E


def test_markdown_markers():
    text = "- REQ-1 (cache): Keep values\n# REQ-A2-3b: Title here\nbody of it\nmore\n## TASK-7 Build\nDo REQ-1.\n- and REQ-404\n# Other\nREQ-9 in prose\n```\n- REQ-5: code\n```\n- REQ-x: no\n"
    got = E.markdown("a.md", text)
    assert got == [
        ("requirement", "REQ-1", "REQ-1", "cache Keep values", []),
        ("requirement", "REQ-A2-3b", "Title here", "body of it more", []),
        ("task", "TASK-7", "Build", "Do REQ-1. and REQ-404", ["REQ-1", "REQ-404"]),
    ]
    assert len(E.markdown("a.md", "# ADR-1 x\n" + "y" * 2000)[0][3]) == 800


def test_symbols_of_each_language():
    names = lambda path, text: [(s[0], s[1]) for s in E.symbols(path, text)]
    assert names("a.py", "class A:\n    def f(self): pass\ndef f(): pass\n") == [("A", 0), ("f", 0), ("f", 1)]
    assert names("a.py", "def broken(:") == []
    assert names("a.rs", "pub fn go() { inner(); }\nstruct S { x: i32 }\n// fn no()\nenum E { A }\ntrait T {}\n") == [("go", 0), ("S", 0), ("E", 0), ("T", 0)]
    assert names("a.go", "func (s *S) Run() {}\nfunc Main() {}\ntype S struct {}\n") == [("Run", 0), ("Main", 0), ("S", 0)]
    assert names("a.ts", "export abstract class C {\n  go(): void {\n  }\n}\ninterface I {}\nenum K {}\ntype X = 1;\nfunction f() {}\n") == [("C", 0), ("go", 0), ("I", 0), ("K", 0), ("X", 0), ("f", 0)]
    start, end = E.symbols("a.ts", "function f() {\n  return '}';\n}\nf();")[0][2:4]
    assert (start, end) == (0, 30)
    assert E.symbols("a.go", "// REQ-3 and TASK-1, ADR-2\nfunc A() {}\n")[0][6] == ["ADR-2", "REQ-3"]
    assert E.symbols("a.txt", "class A {}") == []


def test_imports_of_each_language():
    specs = lambda path, text: [(s, k, t) for s, k, t, _ in E.imports(path, text)]
    assert specs("a.ts", "import x, { y as z } from './a';\nimport type { T } from './t';\nexport * from './b';\nimport './side';\nconst m = import('./dyn'); require('old');\n// import no from 'no'\n") == [
        ("./a", "static", False), ("./t", "static", True), ("./b", "reexport", False), ("./side", "static", False), ("./dyn", "dynamic", False), ("old", "require", False),
    ]
    assert specs("a.py", "import os, a.b\nfrom ..x import y\n") == [("os", "static", False), ("a.b", "static", False), ("..x", "static", False)]
    assert [s for s, *_ in E.imports("a.rs", "use a::{b, c::{d, self}};\nuse e as f;\nmod g;\n")] == ["a::b", "a::c::d", "a::c", "e", "mod g"]
    assert [s for s, *_ in E.imports("a.go", 'import (\n "fmt"\n x "a/b"\n)\nimport "c"\n')] == ["fmt", "a/b", "c"]


def test_schema_fold():
    log = E.ddl("a.sql", """
    CREATE TABLE t (id bigint PRIMARY KEY, n varchar(10) NOT NULL DEFAULT 'a;b', o int, CONSTRAINT fk FOREIGN KEY (o) REFERENCES s.u (id));
    ALTER TABLE t ADD COLUMN p numeric(10, 2) NOT NULL, DROP COLUMN n;  -- gone
    ALTER TABLE t RENAME COLUMN p TO q; ALTER TABLE t ALTER COLUMN q TYPE text; ALTER TABLE t ALTER COLUMN q DROP NOT NULL;
    CREATE UNIQUE INDEX i ON t (q); ALTER TABLE t RENAME TO w; CREATE TABLE gone (x int); DROP TABLE gone; VACUUM;
    """)  # fmt: skip
    folded = E.fold_schema([(a, s, t, n, d, x) for _, a, s, t, n, d, x in log])
    assert set(folded) == {("public", "w")}
    assert folded["public", "w"]["columns"] == {"id": ("bigint", False), "o": ("int", True), "q": ("text", True)}
    assert folded["public", "w"]["constraints"] == {"t_pkey": "primary_key:id", "fk": "foreign_key:o→s.u", "i": "unique_index:q"}
    assert [r[5] for r in log if r[1] == "unknown"] == ["vacuum"]


def test_liquibase_xml_and_yaml():
    xml = """<databaseChangeLog><changeSet id="1" author="a"><createTable tableName="t"><column name="id" type="int"><constraints primaryKey="true"/></column></createTable>
    <addColumn tableName="t"><column name="x" type="text"/></addColumn><rollback><dropTable tableName="t"/></rollback></changeSet></databaseChangeLog>"""
    yaml = "databaseChangeLog:\n- changeSet:\n    id: 1\n    changes:\n    - createTable:\n        tableName: t\n        columns:\n        - column: {name: id, type: int, constraints: {primaryKey: true}}\n    - addColumn:\n        tableName: t\n        columns:\n        - column: {name: x, type: text}\n    rollback:\n    - dropTable: {tableName: t}\n"
    fold = lambda log: E.fold_schema([r[1:] for r in log])
    assert fold(E.liquibase("db/a.xml", xml)) == fold(E.liquibase("db/a.yaml", yaml))
    assert list(fold(E.liquibase("db/a.xml", xml))["public", "t"]["columns"]) == ["id", "x"]
    assert E.liquibase("a.xml", "<x/>") == [] and E.liquibase("a.xml", "<databaseChangeLog") == []


def test_manifests_services_and_mappings():
    assert E.manifest("p/package.json", '{"name": "n", /* c */ "version": "1", "devDependencies": {"b": "1",},}') == [("package", "n", "1", ["b"], None)]
    assert E.manifest("Cargo.toml", '[package]\nname = "c"\nversion = "2"\n[dependencies]\nserde = "1"\n') == [("package", "c", "2", ["serde"], None)]
    assert E.manifest("tsconfig.base.json", '{"extends": "./x.json"}')[0][4] == "x.json"
    assert E.manifest("package.json", "{") == []
    assert E.openapi("o.yaml", "openapi: 3.0.0\npaths:\n  /a/{id}:\n    get: {operationId: x}\n    parameters: []\n") == [("GET", "/a/{}", "x")]
    assert E.http_calls("a.ts", "fetch(`${BASE}/users/${id}?x=1`, { method: 'POST' }); axios.get('https://h/a/:b')") == [("POST", "/users/{}"), ("GET", "/a/{}")]
    assert E.orm("m.py", "class U(Base):\n    __tablename__ = 'users'\n") == [("U", "users")]
    assert E.orm("s.prisma", 'model Post {\n id Int\n @@map("posts")\n}') == [("Post", "posts")]
    assert E.signature("a.py", "def f(a):\n    return a\n") == "def f(a):\n    ..."
    assert E.signature("a.ts", "function f(a) { return '{'; }") == "function f(a) { ... }"
