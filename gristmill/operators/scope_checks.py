"""Checks of Go, Java and JavaScript that need a whole function, class or loop, on the table of ``scopes``.

All facts of a file lie in one partition after one shuffle; every window after that is clustered by it. A
window says what else there is in a function, class or loop, or what came before in it; a check is a
condition on a fact and its windows. Order and nesting are running maxima, not joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scopes import scope_facts

# Names that tell what a call, type or property does.
GO_SLOW_CALLS = r"^http\.(Get|Post|NewRequest)$|\.(Query|Exec|QueryRow)$|^time\.Sleep$"
GO_CONTROL = r"^(sync\.WaitGroup|rate\.Limiter|time\.Sleep|semaphore(\..*)?)$"
GO_WRAPS = r"^(fmt\.Errorf|errors\.(Wrap|Wrapf|New))$"
JAVA_PLAIN_COLLECTIONS = r"\b(HashMap|ArrayList|HashSet|TreeMap|TreeSet|LinkedList)\s*<"
JAVA_RETURNS_MANY = r"(List|Set|Map|Collection)\b|\w\s*\[\s*\]"
JAVA_RESOURCES = r"\b(FileInputStream|FileOutputStream|BufferedReader|BufferedWriter|FileReader|FileWriter)\s+\w+\s+=\s*new\b"
JAVA_BOXED = r"\b(List|Set|Map)\s*<\s*(Integer|Long|Double|Float|Boolean|Character|Byte|Short)\b"
JS_DOM = r"(^|\.)(appendChild|removeChild|insertBefore|innerHTML|outerHTML|textContent|querySelector|querySelectorAll|getElementById|getElementsByClassName)$"
JS_EXPENSIVE = r"^(RegExp|JSON\.parse|JSON\.stringify|(.*\.)?split)$"

MAX_PARAMETERS, MAX_DEFERS, CALLBACK_DEPTH = 5, 3, 4


def _windows(f: DataFrame, key: str) -> DataFrame:
    """The facts with what else there is around each."""
    fn, cls, loop = (Window.partitionBy(key, x) for x in ("fn", "cls", "loop"))
    named = Window.partitionBy(key, "cls", "base")
    before = Window.partitionBy(key, "fn", "base").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key, "base").orderBy("at").rangeBetween(1, Window.unboundedFollowing)
    kind, name, arg = F.col("kind"), F.col("name"), F.col("arg")

    def some(condition: Column, over) -> Column:
        return F.coalesce(F.max(condition).over(over), F.lit(False))

    def call(pattern: str) -> Column:
        return (kind == "call") & name.rlike(pattern)

    pointer = (kind == "define") & arg.rlike(r"\*|\bnew\(")
    mark = F.when(kind == "define", F.when(pointer, "pointer").otherwise("value")).when(kind == "nil", "checked")
    field = (kind == "field") & ~arg.rlike(r"\bfinal\b")
    return f.select(
        "*",
        # in the function
        some(call(GO_SLOW_CALLS), fn).alias("fn_slow"), some((kind.isin("member", "use", "call")) & name.rlike(GO_CONTROL), fn).alias("fn_control"), some(kind == "go", fn).alias("fn_go"),
        some(call(r"^recover$"), fn).alias("fn_recover"), some(call(GO_WRAPS), fn).alias("fn_wraps"), F.sum((name == "defer").cast("int")).over(fn).alias("fn_defers"),
        some(call(r"(^|\.)removeEventListener$") | (name.rlike("(?i)cleanup") & kind.isin("use", "call", "declare")), fn).alias("fn_unlistens"), some(call(r"(^|\.)clearInterval$"), fn).alias("fn_clears"),
        # in the loop
        F.min(F.when(kind.isin("call", "member") & name.rlike(JS_DOM), F.col("at"))).over(loop).alias("loop_dom"), F.sum(call(JS_EXPENSIVE).cast("int")).over(Window.partitionBy(key, "loop", "name")).alias("loop_same"),
        # in the class
        some((kind == "function") & (name == "equals") & arg.rlike(r"\bequals\s*\(\s*(final\s+)?Object\b"), cls).alias("cls_equals"), some((kind == "function") & (name == "hashCode") & arg.rlike(r"\bhashCode\s*\(\s*\)"), cls).alias("cls_hash"),
        some((kind == "sync") | arg.rlike(r"\b(volatile|synchronized)\b") | (name.isin("Thread", "Runnable", "ExecutorService")) | (kind == "class") & arg.rlike(r"\b(Thread|Runnable)\b") | arg.rlike(r"\bExecutorService\b"), cls).alias("cls_threads"),
        some((kind == "loop"), cls).alias("cls_loops"),
        # of the same name in the class
        some(field & arg.rlike(r"\bvolatile\b"), named).alias("is_volatile"), some((kind == "set") & arg.rlike(r"^(\+\+|--|[-+*/]=)") | (kind == "set") & arg.eqNullSafe(""), named).alias("is_stepped"),
        F.sum((kind == "set").cast("int")).over(named).alias("sets"), some((kind == "set") & F.array_contains("inside", "sync") | (kind == "set") & F.col("fn_head").rlike(r"\bsynchronized\b"), named).alias("is_locked"),
        some(call(r"\.(shutdown|shutdownNow)$"), named).alias("is_shut"),
        # before and after
        F.last(mark, True).over(before).alias("mark"), F.last(F.when(pointer, F.col("line_start")), True).over(before).alias("mark_line"),
        F.max(F.when((kind == "define") | (kind == "var"), F.col("scope_end"))).over(before).alias("outer_end"),
        F.sum((kind.isin("use", "set")).cast("int")).over(later).alias("used"),
        # shared variables of the package, and locks in the goroutine
        some((kind == "var") & (F.col("fn") == -1), Window.partitionBy(key, "base")).alias("is_package"), some(call(r"\.R?Lock$"), Window.partitionBy(key, "go")).alias("go_locks"),
        F.row_number().over(Window.partitionBy(key, "fn", "kind").orderBy("at")).alias("nth"), F.sum(call(r"(^|\.)map$").cast("int")).over(Window.partitionBy(key, "line_start")).alias("maps"),
    )


_ARGUMENTS = r"((?:[^()]|\([^()]*\))*)"


def _parameters(head: str) -> Column:
    """Number of parameters in a function's head: commas outside of brackets."""
    go = F.regexp_extract(head, rf"^func\s*(?:\([^)]*\)\s*)?\w+\s*(?:\[[^\]]*\]\s*)?\({_ARGUMENTS}\)", 1)
    java = F.regexp_extract(head, rf"\w+\s*\({_ARGUMENTS}\)\s*(?:throws\s.*)?$", 1)
    flat = F.regexp_replace(F.when(F.col("language") == "go", go).otherwise(java), r"\([^()]*\)|<[^<>]*(?:<[^<>]*>[^<>]*)*>", "")
    return F.when(F.trim(flat) == "", 0).otherwise(F.size(F.split(flat, ",")))


def _checks() -> Iterator[tuple[str, str, str, str, Column, Column, str]]:
    """Check, languages, severity, category, message, condition, and the column of the line."""
    kind, name, base, arg = (F.col(x) for x in ("kind", "name", "base", "arg"))
    is_in = lambda label: F.array_contains("inside", label)
    said = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    call = lambda pattern: (kind == "call") & name.rlike(pattern)
    in_fn, in_loop = F.col("fn") != -1, F.col("loop") != -1
    many, tested = _parameters("arg"), F.concat(F.lit("null:"), base)
    by_value = r"^func\s+\w+\s*\([^)]*\b\w+\s+([A-Z]\w*)\s*\)"
    # Severity, category and message of each check.
    # Go
    yield "go-nil-dereference", "go", "medium", "quality", said("Potential nil pointer dereference: ", base, " used without nil check"), kind.isin("member", "call") & name.contains(".") & (F.col("mark") == "pointer") & in_fn, "mark_line"
    yield "go-shadowed-err", "go", "low", "quality", said("Variable shadowing: err redeclared with :="), (kind == "test") & (name == "err") & (F.col("outer_end") > F.col("at")), "line_start"
    yield "go-parameters", "go", "low", "quality", said("Function has ", many, " parameters (> 5)"), (kind == "function") & (many > MAX_PARAMETERS), "line_start"
    yield "go-context-background", "go", "low", "quality", said("context.Background() in non-main function"), call(r"^context\.Background$") & in_fn & (F.col("fn_name") != "main"), "line_start"
    yield "go-context-missing", "go", "low", "quality", said("Function ", name, " should accept context.Context"), (kind == "function") & F.col("fn_slow") & ~arg.rlike(r"context\.Context|\bctx ") & ~name.startswith("Test"), "line_start"
    yield "go-goroutine-loop", "go", "high", "performance", said("Unbounded goroutine creation in loop: Can exhaust system resources"), (name == "go") & in_loop & ~F.col("fn_control"), "loop_line"
    yield "go-append-loop", "go", "medium", "performance", said("Inefficient slice growth: append() in loop without pre-allocation"), (kind == "call") & (name == "append") & in_loop & ~F.col("grown"), "loop_line"
    yield "go-struct-by-value", "go", "low", "performance", said('Potential inefficiency: Struct "', F.regexp_extract("arg", by_value, 1), '" passed by value'), (kind == "function") & arg.rlike(by_value), "line_start"
    yield "go-blocking-receive", "go", "low", "performance", said("Blocking channel receive without timeout"), (kind == "receive") & ~is_in("select"), "line_start"
    yield "go-channel-alone", "go", "medium", "performance", said("Unbuffered channel without goroutine: May cause deadlock"), call(r"^make$") & arg.rlike(r"^chan\s+[^,]+$") & ~F.col("fn_go"), "line_start"
    yield "go-race", "go", "high", "security", said('Potential race condition: goroutine accesses shared variable "', name, '" without synchronization'), (kind == "use") & F.col("is_package") & (F.col("go") != -1) & ~F.col("go_locks"), "go_line"
    yield "go-panic", "go", "medium", "quality", said("panic without recover: Can crash the program"), call(r"^panic$") & ~F.col("fn_recover"), "line_start"
    yield "go-recover", "go", "high", "quality", said("recover() not in defer: Will not catch panics"), call(r"^recover$") & ~is_in("defer"), "line_start"
    yield "go-ignored-error", "go", "medium", "quality", said("Ignored error: Error return value discarded with _"), (kind == "drop") | (kind == "define") & (name == "_") & arg.rlike(r"^\w[\w.]*\("), "line_start"
    yield "go-error-context", "go", "low", "quality", said("Error returned without context"), (kind == "give") & (name == "err") & ~F.col("fn_wraps"), "line_start"
    yield "go-defer-order", "go", "info", "quality", said("Multiple defer statements: Remember LIFO execution order"), (name == "defer") & (F.col("fn_defers") > MAX_DEFERS) & (F.col("nth") == 1), "line_start"
    # Java
    yield "java-race", "java", "high", "concurrency", said('Potential race condition: Shared mutable field "', name, '" without synchronization'), (kind == "field") & arg.rlike(r"\bstatic\b") & ~arg.rlike(r"\b(final|volatile)\b") & (F.col("sets") > 1) & ~F.col("is_locked"), "line_start"
    yield "java-double-checked", "java", "high", "concurrency", said("Broken double-checked locking: Field must be volatile"), (kind == "if") & ~F.col("is_volatile") & (F.array_position("inside", tested) > 0) & (F.array_position(F.expr("slice(inside, greatest(array_position(inside, concat('null:', base)), 1), size(inside))"), "sync") > 0), "line_start"
    yield "java-volatile-compound", "java", "high", "concurrency", said('Volatile variable "', name, '" used in non-atomic operation'), (kind == "field") & arg.rlike(r"\bvolatile\b") & F.col("is_stepped"), "line_start"
    yield "java-wait-loop", "java", "medium", "concurrency", said("wait() should be called in a loop"), call(r"^(this\.)?wait$") & in_fn & ~is_in("while"), "line_start"
    yield "java-plain-collection", "java", "medium", "concurrency", said(F.regexp_extract("arg", JAVA_PLAIN_COLLECTIONS, 1), " is not thread-safe"), kind.isin("field", "local") & arg.rlike(JAVA_PLAIN_COLLECTIONS) & F.col("cls_threads"), "line_start"
    yield "java-executor", "java", "medium", "concurrency", said("ExecutorService created without shutdown - resource leak"), kind.isin("field", "local") & arg.rlike(r"\bExecutorService\s+\w+\s+=\s*Executors\b") & ~F.col("is_shut"), "line_start"
    yield "java-atomic-check", "java", "high", "concurrency", said('Check-then-act race condition on Atomic variable "', base, '"'), call(r"\.(set|incrementAndGet|decrementAndGet)$") & (F.array_position("inside", F.concat(F.lit("get:"), base)) > 0), "line_start"
    yield "java-null-return", "java", "medium", "quality", said("Returning null from collection method"), (kind == "give") & F.regexp_extract("fn_head", r"^([^(]*)\(", 1).rlike(JAVA_RETURNS_MANY), "line_start"
    yield "java-class-name", "java", "low", "quality", said('Class name "', name, '" not in PascalCase'), (kind == "class") & name.rlike("^[a-z_]") & arg.rlike(r"\bclass\s"), "line_start"
    yield "java-constant-name", "java", "low", "quality", said('Constant "', name, '" not in UPPER_SNAKE_CASE'), (kind == "field") & arg.rlike(r"^(public|private|protected)\s+static\s+final\s+\w+\s+[a-z]\w*\s+="), "line_start"
    yield "java-equals", "java", "high", "quality", said("equals() overridden without hashCode()"), (kind == "function") & (name == "equals") & F.col("cls_equals") & ~F.col("cls_hash"), "line_start"
    yield "java-hash-code", "java", "medium", "quality", said("hashCode() overridden without equals()"), (kind == "function") & (name == "hashCode") & F.col("cls_hash") & ~F.col("cls_equals"), "line_start"
    yield "java-parameters", "java", "medium", "quality", said("Method has ", many, " parameters (> 5)"), (kind == "function") & (many > MAX_PARAMETERS), "line_start"
    yield "java-matches-loop", "java", "medium", "performance", said("String.matches() in loop - compiles pattern each time"), call(r"(^|\.)matches$") & in_loop & arg.startswith('"'), "line_start"
    yield "java-resource", "java", "high", "performance", said("Resource not using try-with-resources - potential leak"), (kind == "local") & arg.rlike(JAVA_RESOURCES) & ~F.col("in_resources"), "line_start"
    yield "java-autoboxing", "java", "medium", "performance", said(F.regexp_extract("arg", JAVA_BOXED, 1), "<", F.regexp_extract("arg", JAVA_BOXED, 2), "> causes autoboxing overhead"), kind.isin("field", "local") & arg.rlike(JAVA_BOXED) & F.col("cls_loops"), "line_start"
    # JavaScript and TypeScript
    js = "javascript,typescript"
    yield "js-dom-loop", js, "medium", "performance", said('DOM operation "', F.regexp_extract("name", r"(\w+)$", 1), '" inside loop causes reflow/repaint on each iteration'), (F.col("at") == F.col("loop_dom")) & kind.isin("call", "member") & in_loop, "loop_line"
    yield "js-listener", js, "medium", "performance", said("Event listener added without cleanup: potential memory leak"), call(r"(^|\.)addEventListener$") & in_fn & ~F.col("fn_unlistens"), "line_start"
    yield "js-interval", js, "high", "performance", said("setInterval without clearInterval: memory leak"), call(r"(^|\.)setInterval$") & in_fn & ~F.col("fn_clears"), "line_start"
    yield "js-unused", js, "info", "dead_code", said("Variable '", name, "' appears to be unused"), (kind == "declare") & (F.coalesce("used", F.lit(0)) == 0), "line_start"
    yield "js-callback-depth", js, "medium", "smell", said("Deeply nested callback detected (callback hell)"), (kind == "closure") & (F.size(F.filter("inside", lambda x: x == "closure")) >= CALLBACK_DEPTH - 1), "line_start"
    yield "js-loop-expensive", js, "medium", "performance", said('Expensive operation "', F.when(name == "RegExp", "new RegExp").when(name.endswith("split"), ".split(").otherwise(name), '" repeated in loop'), call(JS_EXPENSIVE) & in_loop & (F.col("loop_same") > 1), "loop_line"
    yield "js-push-loop", js, "low", "performance", said("Array.push() in loop: consider using array spread or map()"), call(r"\.push$") & is_in("loop") & F.col("in_for"), "loop_line"
    yield "js-array-twice", js, "low", "performance", said("Multiple array iterations: .map() and .filter() iterate twice"), call(r"(^|\.)filter$") & (F.col("maps") > 0), "line_start"


def check_scopes(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """``key``, language, check, severity, category, message, line_start: one row for each check, line and message.

    ``files`` has ``key``, language and ``text``; files of other languages, null and empty texts have no finding; equal
    findings of a line are one.
    """
    f = scope_facts(files, key, text).repartition(key)
    # append(x, ...) stands for x: whether x was made with a capacity.
    grown = F.when((F.col("kind") == "call") & (F.col("name") == "append"), F.regexp_extract("arg", r"^\s*(\w+)", 1))
    w = _windows(f, key)
    sized = F.collect_set(F.when((F.col("kind") == "define") & F.col("arg").rlike(r"\bmake\([^()]*(\([^()]*\))?[^()]*,"), F.col("name"))).over(Window.partitionBy(key, "fn"))
    w = w.withColumn("grown", F.array_contains(sized, grown)).withColumn("in_for", F.col("loop") != -1)
    # A try with resources declares them before its brace, on the line where it begins.
    heads = F.collect_set(F.when((F.col("kind") == "try") & F.col("arg").rlike(r"^try\s*\("), F.col("line_start"))).over(Window.partitionBy(key, "fn"))
    w = w.withColumn("in_resources", F.array_contains(heads, F.col("line_start")))
    found = [
        F.when(F.col("language").isin(*languages.split(",")) & condition, F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"), F.col(line).cast("long").alias("line_start")))
        for check, languages, severity, category, message, condition, line in _checks()
    ]
    out = w.select(key, "language", F.explode(F.array_compact(F.array(*found))).alias("m"))
    return out.select(key, "language", "m.*").distinct()
