"""Source texts with something to find and something to pass over; suppliers deal them out, so that ids and lines vary by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

#: By language: lines, each with the detectors that must find something in it.
LINES: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "go": [
        ('db.Query("SELECT a FROM t WHERE id = " + id)', ("go-sql-concat", "go-sql-literal")), ('db.Query(fmt.Sprintf("x %s", id))', ("go-sql-sprintf", "go-sql-sprint")),
        ('exec.Command("ls " + dir)', ("go-command-concat",)), ("f, _ := os.Open(base + name)", ("go-path-open",)), ("h := sha1.New()", ("go-sha1",)), ("h := sha256.New()", ()),
        ('password = "hunter2hunter2"', ("go-password",)), ('http.Get("http://a/" + host)', ("go-ssrf-get",)), ("defer f.Close()", ("go-close-error",)), ("if err != nil {}", ("go-empty-error-check",)),
        ("var x interface{}", ("go-empty-interface",)), ('db.Query("SELECT 1")', ()),
    ],
    "java": [
        ('stmt.executeQuery("SELECT " + name);', ("java-sql-concat",)), ("new XMLDecoder(in);", ("java-xml-decoder",)), ('Runtime.getRuntime().exec("ls " + d);', ("java-exec",)),
        ("try { run(); } catch (Throwable t) { t.printStackTrace(); }", ("java-catch-throwable", "java-stack-trace")), ("Date d = new Date();", ("java-date",)), ("LocalDate d = LocalDate.now();", ()), ("if (x == null) y();", ("java-null-check",)), ("if (Objects.isNull(x)) y();", ()),
        ('synchronized ("lock") { x(); }', ("java-sync-string",)), ("private static SimpleDateFormat F;", ("java-date-format",)), ('String s = new String("a");', ("java-new-string",)),
        ("Boolean b = Boolean.valueOf(true);", ("java-boolean-value",)), ("Integer i = Integer.valueOf(5);", ("java-boxing",)), ("catch (IOException e) { }", ("java-empty-catch",)), ("list.parallelStream().count();", ("java-parallel-stream",)),
    ],
    "javascript": [
        ("el.innerHTML = x", ("js-inner-html",)), ('el.innerHTML="a"', ()), ("document.write(x)", ("js-document-write",)), ("eval(x)", ("js-eval",)), ("new Function(x)", ("js-function",)),
        ('createHash("md5")', ("js-weak-hash",)), ('createHash("sha256")', ()), ("var a = 1", ("js-var",)), ("console.log(a)", ("js-console",)), ("let b = a ? c ? 1 : 2 : 3", ("js-nested-ternary",)),
        ("<a onClick={() => f()}>", ("js-inline-function",)), ("<a onClick={f}>", ()), ("useEffect(() => { f })", ("js-use-effect",)), ("useEffect(() => { f }, [a])", ()),
        ('import _ from "lodash"', ("js-lodash",)), ('import moment from "moment"', ("js-moment",)),
    ],
    "typescript": [("let a: any = 1", ("ts-any",)), ("let b: any[] = []", ("ts-any", "ts-any-array")), ("let c: string = d", ()), ("let e = f as G", ("ts-assertion",)), ("let e = f as const", ()), ('let h = "a" + i', ("ts-coercion",)), ("function k(l) {}", ("ts-return-type", "ts-parameter-types")), ("function k(l: string): void {}", ()), ("m!.n()", ("ts-non-null",)), ("let o = (p) => {}", ("ts-arrow-return-type",)), ("q(<R>s)", ("ts-old-assertion",)), ("q = <R>s", ()), ("if (!!a) { }", ("ts-double-negation",))],
    "rust": [
        ("unsafe fn f() {}", ("rust-unsafe-fn",)), ("let x = a.unwrap_or_default();", ("rust-unwrap-default",)), ("todo!();", ("rust-todo",)), ("unimplemented!();", ("rust-unimplemented",)),
        ("if v.len() == 0 {}", ("rust-len-zero",)), ("if v.is_empty() {}", ()), ("if ok == true {}", ("rust-equals-true",)), ("x.ok();", ("rust-ok-ignored",)), ("mem::transmute::<A, B>(x);", ("rust-transmute",)),
        ("let p: i32 = q7.clone();", ("rust-clone-i32",)), ("let c8 = d8.clone();", ("rust-clone-twice",)), ("let e8 = d8.clone();", ()), ("let m9 = &mut v9;", ("rust-two-mutable",)), ("let n9 = &mut v9;", ()), ("let m5 = &v5;", ("rust-mutable-shared",)), ("let n5 = &mut v5;", ()),
        ("let y: Rc<RefCell<T>>;", ("rust-rc-refcell",)), ("let z: Arc<Mutex<T>>;", ("rust-arc-mutex",)), ("async { Arc<Mutex<T>> }", ()), ('f(String::from("a"));', ("rust-string-from",)), ('fn s() -> S { String::from("a"); }', ()),
        ('let g = "a" + b + "c";', ("rust-string-plus",)), ("let n = i.collect::<Vec<T>>().len();", ("rust-collect-len",)), ("i.collect::<Vec<T>>().iter();", ("rust-collect-iter",)), ("i.iter().map(f).collect();", ("rust-iter-collect",)),
        ("for a in b { c.to_string(); d.await }", ("rust-to-string-loop", "rust-await-loop")), ('for a in b { format!("c") }', ("rust-format-loop",)), ("let w: Box<i32>;", ("rust-box-i32",)), ("let w: Box<Wide>;", ()), ("m.lock().get().await;", ("rust-lock-await",)),
        ("let r6 = s6;", ("rust-moved-let",)), ("s6.go();", ()), ("fn h(x: &str) -> &str { x }", ("rust-lifetime",)), ("fn h<'a>(x: &'a str) -> &'a str { x }", ()), ("async fn t() { std::thread::sleep(d) }", ("rust-async-sleep",)),
    ],
}
LANGUAGES = tuple(LINES)

#: Python texts with the checks, severities and lines that must be found.
PYTHON: list[tuple[str, list[tuple[str, str, int]]]] = [
    ("import os\nimport sys\nprint(sys.argv)\n", [("unused-import", "info", 1)]),
    ("def f(a=[]):\n    return a\n", [("unused-function", "info", 1), ("mutable-default", "high", 1), ("return-annotation", "low", 1)]),
    ("try:\n    x = 1\nexcept:\n    pass\n", [("bare-except", "medium", 3), ("swallowed", "medium", 3)]),
    ("from os import *\n", [("wildcard-import", "low", 1)]),
    ("x = None\nif x == None:\n    pass\n", [("none-equality", "low", 2)]),
    ('password = "hunter2hunter2"\n', [("secret", "critical", 1)]),
    ("for a in b:\n    cursor.execute(a)\n", [("query-loop", "high", 1)]),
    ("eval(x)\n", [("eval", "critical", 1)]),
    ("def f():\n    return 1\n    x = 2\n", [("unused-function", "info", 1), ("return-annotation", "low", 1), ("unreachable", "medium", 3)]),
    ("# TODO later\n", [("todo", "info", 1)]),
    ("x = 1\n", []),
    ("def f(:\n", [("syntax", "critical", 1)]),
    ("for a in b:\n    for c in a:\n        for d in c:\n            s += 'x'\n", [("concat-loop", "medium", 1), ("nested-loops", "medium", 1), ("concat-loop", "medium", 2), ("concat-loop", "medium", 3)]),
]
#: Python texts with the sinks, severities and lines that outside data must be found to reach.
TAINT: list[tuple[str, list[tuple[str, str, int]]]] = [
    ("def f(request):\n    q = request.args.get('q')\n    s = 'select ' + q\n    cursor.execute(s)\n", [("cursor.execute (sql)", "critical", 4)]),
    ("def f(n):\n    s = 'select ' + n\n    cursor.execute(s)\n", []),
    ("def f(n):\n    q = input()\n    if n:\n        os.system(f'ls {q}')\n    else:\n        n = 1\n", [("os.system (command)", "critical", 4)]),
    ("def f(n):\n    q = input()\n    x = int(q)\n    eval(x)\n", []),
    ("page = requests.get(u)\nopen(page)\n", [("open (file)", "high", 2)]),
    ("def f(n):\n    q = os.getenv('A')\n    try:\n        n += q\n    except E:\n        eval(n)\n", [("eval (eval)", "critical", 6)]),
    ("def f(data):\n    while data:\n        subprocess.run(a, data.b, cwd=g(data))\n", [("subprocess.run (command)", "critical", 3)] * 2),
]
#: Go texts with the block checks and lines that must be found.
BLOCKS: list[tuple[str, list[tuple[str, str, int]]]] = [
    ('go func() {\n\tfor i := range x {\n\t\ts += "a"\n\t}\n}()\n', [("go-goroutine-leak", "high", 1), ("go-concat-loop", "medium", 2)]),
    ("go func() {\n\tselect {\n\tcase <-done:\n\t}\n}()\n", []),
    ("for _, r := range rows {\n\tdb.Query(r)\n\tdefer f()\n\tjson.Marshal(r)\n}\n", [("go-query-loop", "high", 1), ("go-defer-loop", "medium", 1), ("go-json-loop", "medium", 1)]),
    ('for i := range x {\n\tb.WriteString("a")\n}\n', []),
]

#: Go, Java and JavaScript texts with the checks of whole functions, classes and loops that must find something, with severity and line.
SCOPES: list[tuple[str, str, list[tuple[str, str, int]]]] = [
    ("go", "func load(id int) {\n\tp := new(T)\n\tp.Run()\n}\n", [("go-nil-dereference", "medium", 2)]),
    ("go", "func load(id int) {\n\tp := new(T)\n\tif p != nil {\n\t\tp.Run()\n\t}\n\tq := f(p)\n\tq.Run()\n}\n", []),
    ("go", "func a() error {\n\terr := f()\n\tif err := g(); err != nil {\n\t\treturn fmt.Errorf(\"g: %w\", err)\n\t}\n\treturn err\n}\n", [("go-shadowed-err", "low", 3)]),
    ("go", "func a() error {\n\tif x {\n\t\terr := f()\n\t\tuse(err)\n\t}\n\tif err := g(); err != nil {\n\t\treturn err // no context\n\t}\n\treturn nil\n}\n", [("go-error-context", "low", 7)]),
    ("go", "func (s *S) put(a, b int, c func(x, y int) bool, d, e, f string) (int, error) {\n\treturn 1, nil\n}\n", [("go-parameters", "low", 1)]),
    ("go", "func (s *S) put(a, b int, c func(x, y int) bool, d, e string) (int, error) {\n\treturn 1, nil\n}\n", []),
    ("go", "func main() {\n\tctx := context.Background()\n}\nfunc run() {\n\tf(context.Background()) // \"{\n}\n", [("go-context-background", "low", 5)]),
    ("go", "func fetch(u string) {\n\thttp.Get(u)\n}\nfunc get(ctx context.Context) {\n\tdb.Query(q)\n}\nfunc TestX(t int) {\n\ttime.Sleep(1)\n}\nfunc other() {\n\ts := \"http.Get(u)\"\n}\n", [("go-context-missing", "low", 1)]),
    ("go", "func all() {\n\tfor _, x := range xs {\n\t\tgo work(x)\n\t}\n}\n", [("go-goroutine-loop", "high", 2)]),
    ("go", "func all() {\n\tvar wg sync.WaitGroup\n\tfor _, x := range xs {\n\t\tgo work(x)\n\t}\n\twg.Wait()\n}\n", []),
    ("go", "func up() {\n\tvar out []int\n\tfor i := range xs {\n\t\tout = append(out, i)\n\t}\n}\n", [("go-append-loop", "medium", 3)]),
    ("go", "func up() {\n\tout := make([]int, 0, len(xs))\n\tfor i := range xs {\n\t\tout = append(out, i)\n\t}\n}\n", []),
    ("go", "func show(c Config) {\n}\nfunc hide(c *Config) {\n}\n", [("go-struct-by-value", "low", 1)]),
    ("go", "func w() {\n\tv := <-ch\n\tch <- v\n\tselect {\n\tcase x := <-ch:\n\t\tuse(x)\n\t}\n}\n", [("go-blocking-receive", "low", 2)]),
    ("go", "func w() {\n\tch := make(chan int)\n\tdone := make(chan int, 1)\n}\nfunc v() {\n\tch := make(chan int)\n\tgo func() { ch <- 1 }()\n}\n", [("go-channel-alone", "medium", 2)]),
    ("go", "var total int\nfunc w() {\n\tgo func() {\n\t\ttotal++\n\t}()\n\tgo func() {\n\t\tmu.Lock()\n\t\ttotal++\n\t}()\n}\n", [("go-race", "high", 3)]),
    ("go", "func w() {\n\tpanic(\"recover()\")\n}\nfunc v() {\n\tdefer func() {\n\t\trecover()\n\t}()\n\tpanic(1)\n}\n", [("go-panic", "medium", 2)]),
    ("go", "func v() {\n\tr := recover()\n\tuse(r)\n}\n", [("go-recover", "high", 2)]),
    ("go", "func v() {\n\t_ = f(1)\n\tx, _ := g(2)\n\ty, ok := m[3]\n}\n", [("go-ignored-error", "medium", 2), ("go-ignored-error", "medium", 3)]),
    ("go", "func v() {\n\tdefer a()\n\tdefer b()\n\tdefer c()\n\tdefer d()\n}\nfunc w() {\n\tdefer a()\n}\n", [("go-defer-order", "info", 2)]),
    ("java", "class C {\n  private static int hits;\n  private static final int MAX = 5;\n  void a() { hits++; }\n  void b() { hits = 0; }\n}\n", [("java-race", "high", 2)]),
    ("java", "class C {\n  private static int hits;\n  synchronized void a() { hits++; }\n  synchronized void b() { hits = 0; }\n}\n", []),
    ("java", "class C {\n  private Foo foo;\n  Foo get() {\n    if (foo == null) {\n      synchronized (this) {\n        if (foo == null) {\n          foo = new Foo();\n        }\n      }\n    }\n    return foo;\n  }\n}\n", [("java-double-checked", "high", 6)]),
    ("java", "class C {\n  private volatile Foo foo;\n  Foo get() {\n    if (foo == null) {\n      synchronized (this) {\n        if (foo == null) {\n          foo = new Foo();\n        }\n      }\n    }\n    return foo;\n  }\n}\n", []),
    ("java", "class C {\n  private volatile int n;\n  private volatile int m;\n  void a() { n += 1; m = 2; }\n}\n", [("java-volatile-compound", "high", 2)]),
    ("java", "class C {\n  void a() { while (!ok) { wait(); } }\n  void b() { if (!ok) { wait(); } }\n}\n", [("java-wait-loop", "medium", 3)]),
    ("java", "class C implements Runnable {\n  private Map<String, Foo> m = new HashMap<String, Foo>();\n  private Map<String, Foo> n = new ConcurrentHashMap<>();\n}\n", [("java-plain-collection", "medium", 2)]),
    ("java", "class C {\n  private Map<String, Foo> m = new HashMap<String, Foo>();\n}\n", []),
    ("java", "class C {\n  void a() {\n    ExecutorService p = Executors.newFixedThreadPool(4);\n    ExecutorService q = Executors.newCachedThreadPool();\n    q.shutdown();\n  }\n}\n", [("java-executor", "medium", 3)]),
    ("java", "class C {\n  void a() {\n    if (n.get() > 0) {\n      n.set(1);\n    }\n    if (m.get() > 0) {\n      k.set(1);\n    }\n  }\n}\n", [("java-atomic-check", "high", 4)]),
    ("java", "class C {\n  public List<Foo> all() {\n    return null;\n  }\n  public Foo one() {\n    return null;\n  }\n}\n", [("java-null-return", "medium", 3)]),
    ("java", "class parser {\n  private static final int limit = 3;\n  private static final int LIMIT = 3;\n}\nclass Parser {\n}\n", [("java-class-name", "low", 1), ("java-constant-name", "low", 2)]),
    ("java", "class A {\n  public boolean equals(Object o) { return true; }\n}\nclass B {\n  public int hashCode() { return 1; }\n}\nclass D {\n  public boolean equals(Object o) { return true; }\n  public int hashCode() { return 1; }\n}\n", [("java-equals", "high", 2), ("java-hash-code", "medium", 5)]),
    ("java", "class C {\n  void a(int b, Map<String, Foo> c, int d, int e, int f, int g) { }\n  void h(int b, Map<String, Foo> c, int d, int e, int f) { }\n}\n", [("java-parameters", "medium", 2)]),
    ("java", "class C {\n  void a() {\n    for (String s : t) {\n      if (s.matches(\"a+\")) { }\n    }\n    u.matches(\"b+\");\n  }\n}\n", [("java-matches-loop", "medium", 4)]),
    ("java", "class C {\n  void a() {\n    FileReader r = new FileReader(f);\n    try (FileReader s = new FileReader(f)) { r.read(); }\n  }\n}\n", [("java-resource", "high", 3)]),
    ("java", "class C {\n  void a() {\n    List<Integer> n = f();\n    for (int i : n) { }\n  }\n}\nclass D {\n  private List<Integer> n;\n}\n", [("java-autoboxing", "medium", 3)]),
    ("javascript", "function f(xs) {\n  xs.forEach((x) => {\n    el.appendChild(x)\n    el.innerHTML = x\n  })\n  el.appendChild(xs)\n}\n", [("js-dom-loop", "medium", 2)]),
    ("javascript", "function f() {\n  el.addEventListener('x', g)\n}\nfunction h() {\n  el.addEventListener('x', g)\n  return () => { el.removeEventListener('x', g) }\n}\n", [("js-listener", "medium", 2)]),
    ("typescript", "function f() {\n  setInterval(() => { g() }, 5)\n}\nfunction h() {\n  const t = setInterval(g, 5)\n  return () => { clearInterval(t) }\n}\n", [("js-interval", "high", 2)]),
    ("javascript", "const a = 1\nconst b = 2\nconst c = `x ${b} a`\nfoo(c, 'a') // a\n", [("js-unused", "info", 1)]),
    ("javascript", "a(() => {\n  b(() => {\n    c(() => {\n      d(() => {\n      })\n    })\n  })\n})\n", [("js-callback-depth", "medium", 4)]),
    ("javascript", "for (const x of xs) {\n  f(JSON.parse(x), JSON.parse(y))\n}\nfor (const x of xs) {\n  f(JSON.parse(x))\n}\n", [("js-loop-expensive", "medium", 1)]),
    ("javascript", "for (let i = 0; i < n; i++) {\n  out.push(i)\n}\nout.push(9)\n", [("js-push-loop", "low", 1)]),
    ("javascript", "use(xs.map(f).filter(g))\nuse(xs.map(f))\n", [("js-array-twice", "low", 1)]),
]

#: Python texts with the findings of checks that follow paths.
PATHS: list[tuple[str, list[tuple[str, str, int]]]] = [
    ("def f(p):\n    f = open(p)\n    if p:\n        return\n    f.close()\n", [("resource-leak", "high", 2)]),
    ("def f(p):\n    f = open(p)\n    if p:\n        f.close()\n        return\n    f.close()\n", []),
    ("def f(p):\n    f = open(p)\n    try:\n        x = f.read()\n    except ValueError:\n        return 0\n    f.close()\n    return x\n", [("resource-leak", "high", 2)]),
    ("def f(p):\n    f = open(p)\n    try:\n        return f.read()\n    finally:\n        f.close()\n", []),
    ("def f(p):\n    c = sqlite3.connect(p)\n    while True:\n        if c.ready():\n            break\n    raise E\n", [("resource-leak", "high", 2)]),
    ("def f(ps):\n    for p in ps:\n        f = open(p)\n    f.close()\n", [("resource-leak", "high", 3)]),
    ("def f(p):\n    with open(p) as f, closing(socket.socket()) as s:\n        return f.read() + s.recv(1)\n", []),
    ("def f(p):\n    return json.loads(open(p).read())\n", [("resource-leak", "high", 2)]),
    ("def f(self, p):\n    f = open(p)\n    self.files.append(f)\n    return f\n", []),
    ("def f(p):\n    f = None\n    try:\n        f = open(p)\n        g(f)\n    finally:\n        if f is not None:\n            f.close()\n", []),
    ("def f(p):\n    if p:\n        return 1\n", [("mixed-returns", "medium", 1)]),
    ("def f(p):\n    if p:\n        return 1\n    raise E\n", []),
    ("def f(p) -> Optional[int]:\n    if p:\n        return 1\n", []),
    ("def f(p):\n    while True:\n        if p:\n            return 1\n", []),
    ("def f(p):\n    match p:\n        case 1:\n            return 2\n        case 2:\n            return\n        case _:\n            return 3\n", [("mixed-returns", "medium", 1)]),
    ("import threading\nn = 0\ndef f():\n    global n\n    with lock:\n        n += 1\n    n += 2\n", [("shared-state", "medium", 7)]),
    ("from threading import Lock\ndef f(a):\n    global n\n    lock.acquire()\n    if a:\n        lock.release()\n    n = 1\n", [("shared-state", "medium", 7)]),
    ("def f():\n    global n\n    n = 1\n", []),
]

#: Texts with fixes and what becomes of them; KEY stands for a number that varies by file.
EDITS: list[tuple[str, str, str, int]] = [
    ("python", "import os, sys\nimport json\nfrom a import (b,\n    cKEY)\nprint(sys.argv, cKEY)\n", "import sys\nfrom a import cKEY\nprint(sys.argv, cKEY)\n", 3),
    ("python", "def f(xKEY=[], y=1):\n    return xKEY == None\n", "def f(xKEY=None, y=1):\n    if xKEY is None:\n        xKEY = []\n    return xKEY is None\n", 2),
    ("python", "try:\n    a = 'KEY'  # except:\nexcept:\n    b = 'é x == None'\n", "try:\n    a = 'KEY'  # except:\nexcept Exception:\n    b = 'é x == None'\n", 1),
    ("python", "s = 'é{} of {}'.format(aKEY, b.c)\nt = '%s-%s' % (aKEY, b)\nu = 'a' + bKEY + 'c'\nv = '{'.format(a)\n", "s = f\"é{aKEY} of {b.c}\"\nt = f\"{aKEY}-{b}\"\nu = f\"a{bKEY}c\"\nv = '{'.format(a)\n", 3),
    ("python", "def f(:\n    return x == None\n", "def f(:\n    return x == None\n", 0),
    ("javascript", "var aKEY = 1\nvar b = 2\nb++\nif (aKEY == b && c != '==') { d() } // ==\n", "const aKEY = 1\nlet b = 2\nb++\nif (aKEY === b && c !== '==') { d() } // ==\n", 4),
    ("javascript", "const s = \"xKEY\" + a + \"y\"\nf(function (x) { return x })\nf(function () { return this })\nconst t = o.n || KEY\nu(v && v.w)\n", "const s = `xKEY${a}y`\nf((x) => { return x })\nf(function () { return this })\nconst t = o.n ?? KEY\nu(v?.w)\n", 4),
    ("go", "var x = y == nil\n", "var x = y == nil\n", 0),
]


def dealt(spark: SparkSession, sf_dir: str, texts: list[str], languages: list[str]) -> DataFrame:
    """``file_path, language, content``: one text for each supplier, by its key, after up to four empty lines."""
    s = tables.table(spark, sf_dir, "supplier").select("s_suppkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("s_suppkey") % len(values) + 1).cast("int"))
    content = F.concat(F.expr("repeat('\\n', cast(s_suppkey % 5 as int))"), pick(texts))
    return s.select(F.col("s_suppkey").cast("string").alias("file_path"), pick(languages).alias("language"), content.alias("content"))


def expected_sql(found: list[list[tuple[str, str, int]]], name: str) -> str:
    """SQL for file_path, ``name``, severity, line of what must be found in texts that ``dealt`` deals out."""
    rows = ", ".join(f"({k}, '{what}', '{grave}', {line})" for k, each in enumerate(found) for what, grave, line in each)
    return f"SELECT CAST(s_suppkey AS VARCHAR) AS file_path, v.what AS {name}, v.severity, CAST(v.line + s_suppkey % 5 AS BIGINT) AS line FROM supplier JOIN (VALUES {rows}) v(k, what, severity, line) ON s_suppkey % {len(found)} = v.k"


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Python functions for each supplier: ``f`` with some branches after each other, ``g`` with as many inside each other."""
    s = tables.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 8).cast("int").alias("k"))
    flat = "concat('def f(a):\\n', repeat('    if a:\\n        a = 1\\n', k), '    return a\\n\\n\\n')"
    deep = "concat('def g(a):\\n', array_join(transform(sequence(0, k), i -> concat(repeat('    ', i + 1), if(i < k, 'if a:\\n', 'return a\\n'))), ''))"
    return s.select(F.col("s_suppkey").cast("string").alias("file_path"), F.lit("python").alias("language"), F.expr(f"concat(repeat('\\n', cast(s_suppkey % 5 as int)), {flat}, {deep})").alias("content"))


#: The figures of those functions, from how they are made. In ``f`` 3 k + 1 names and numbers are two words; ``g`` has one word.
BRANCHES_SQL = """SELECT *, CASE WHEN volume > 0 THEN round(greatest(0, (171 - 5.2 * ln(volume) - 0.23 * cyclomatic - 16.2 * ln(loc)) / 171 * 100), 2) ELSE 100.0 END AS maintainability FROM (
SELECT CAST(s_suppkey AS VARCHAR) AS file_path, 'f' AS name, CAST(s_suppkey % 5 + 1 AS BIGINT) AS line_start, CAST(2 * k + 2 AS BIGINT) AS loc, CAST(1 + k AS BIGINT) AS cyclomatic, CAST(k AS BIGINT) AS cognitive, CAST(least(k, 1) AS BIGINT) AS nesting, CASE WHEN k > 0 THEN CAST(3 * k + 1 AS DOUBLE) ELSE 0.0 END AS volume FROM (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier)
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 'g', CAST(s_suppkey % 5 + 2 * k + 5 AS BIGINT), CAST(k + 2 AS BIGINT), CAST(1 + k AS BIGINT), CAST(k * (k + 1) // 2 AS BIGINT), CAST(k AS BIGINT), 0.0 FROM (SELECT s_suppkey, s_suppkey % 8 AS k FROM supplier))"""
