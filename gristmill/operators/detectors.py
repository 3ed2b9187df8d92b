"""Detectors for Go, Java, JavaScript, TypeScript and Rust sources: patterns with guards on what stands around.

A detector finds every match of its pattern in texts of its languages. A guard looks at the text
within some characters of the match (``behind``: before it only): ``unless`` drops the match if any of
its words is there, ``only_if`` if none is; ``unless_line`` if the line where it begins fits. All of it is one column expression a language; no Python runs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regex


@dataclass(frozen=True)
class Detector:
    id: str
    severity: str
    category: str
    message: str
    pattern: str
    flags: str = ""
    around: int = 0
    unless: tuple[str, ...] = ()
    only_if: tuple[str, ...] = ()
    behind: bool = False
    unless_line: str = ""

    def java_pattern(self) -> str:
        return regex.flags(self.pattern, "i" in self.flags, "m" in self.flags, "s" in self.flags)


D = Detector
# What is looked for in each language, how grave it is, and what is said about it.
GO = (
    D("go-sql-concat", "critical", "security", "Potential SQL injection: String concatenation in SQL query", r"(Query|Exec|QueryRow)\s*\([^)]*\+\s*\w+", "i"),
    D("go-sql-sprintf", "critical", "security", "Potential SQL injection: fmt.Sprintf in SQL query", r"(Query|Exec|QueryRow)\s*\([^)]*fmt\.Sprintf", "i"),
    D("go-sql-sprint", "critical", "security", "Potential SQL injection: fmt.Sprint in SQL query", r"(Query|Exec|QueryRow)\s*\([^)]*fmt\.Sprint", "i"),
    D("go-sql-literal", "critical", "security", "Potential SQL injection: SQL query with string concatenation", r'"(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)[^"]*"\s*\+', "i"),
    D("go-command-concat", "critical", "security", "Potential command injection: String concatenation in exec.Command", r"exec\.Command\s*\([^)]*\+\s*\w+"),
    D("go-command-sprintf", "critical", "security", "Potential command injection: fmt.Sprintf in exec.Command", r"exec\.Command\s*\([^)]*fmt\.Sprintf"),
    D("go-command-context", "critical", "security", "Potential command injection: String concatenation in exec.CommandContext", r"exec\.CommandContext\s*\([^)]*\+\s*\w+"),
    D("go-syscall-exec", "critical", "security", "Potential command injection: String concatenation in syscall.Exec", r"syscall\.Exec\s*\([^)]*\+\s*\w+"),
    D("go-path-open", "high", "security", "Potential path traversal: os.Open with string concatenation", r"os\.Open\s*\([^)]*\+\s*\w+", "", 200, ("filepath.Clean", "path.Clean")),
    D("go-path-ioutil", "high", "security", "Potential path traversal: ioutil.ReadFile with string concatenation", r"ioutil\.ReadFile\s*\([^)]*\+\s*\w+", "", 200, ("filepath.Clean", "path.Clean")),
    D("go-path-readfile", "high", "security", "Potential path traversal: os.ReadFile with string concatenation", r"os\.ReadFile\s*\([^)]*\+\s*\w+", "", 200, ("filepath.Clean", "path.Clean")),
    D("go-path-join", "high", "security", "Potential path traversal: filepath.Join without path validation", r"filepath\.Join\s*\([^)]*\w+\s*\)", "", 200, ("filepath.Clean", "path.Clean")),
    D("go-md5", "high", "security", "Weak cryptography: MD5 is cryptographically broken", r"md5\.New\s*\("),
    D("go-sha1", "high", "security", "Weak cryptography: SHA-1 is cryptographically weak", r"sha1\.New\s*\("),
    D("go-des", "high", "security", "Weak cryptography: DES is insecure", r"crypto/des"),
    D("go-rc4", "high", "security", "Weak cryptography: RC4 is insecure", r"crypto/rc4"),
    D("go-password", "critical", "security", "Hardcoded password detected", r"""(?:password|passwd|pwd)\s*[:=]\s*["'](?!.*\$\{)([^"']{8,})["']""", "i"),
    D("go-api-key", "critical", "security", "Hardcoded API key detected", r"""(?:api[_-]?key|apikey)\s*[:=]\s*["']([A-Za-z0-9_\-]{20,})["']""", "i"),
    D("go-secret-key", "critical", "security", "Hardcoded secret key detected", r"""(?:secret[_-]?key|secretkey)\s*[:=]\s*["']([A-Za-z0-9_\-]{20,})["']""", "i"),
    D("go-access-token", "critical", "security", "Hardcoded access token detected", r"""(?:access[_-]?token|accesstoken)\s*[:=]\s*["']([A-Za-z0-9_\-]{20,})["']""", "i"),
    D("go-private-key", "critical", "security", "Hardcoded private key detected", r"""(?:private[_-]?key|privatekey)\s*[:=]\s*["']([^"']{20,})["']""", "i"),
    D("go-ssrf-get", "high", "security", "Potential SSRF: HTTP request with user-controlled URL", r"http\.Get\s*\([^)]*\+\s*\w+"),
    D("go-ssrf-post", "high", "security", "Potential SSRF: HTTP request with user-controlled URL", r"http\.Post\s*\([^)]*\+\s*\w+"),
    D("go-ssrf-request", "high", "security", "Potential SSRF: HTTP request with user-controlled URL", r"http\.NewRequest\s*\([^)]*\+\s*\w+"),
    D("go-close-error", "low", "quality", "Deferred Close() error ignored", r"defer\s+\w+\.Close\s*\(\s*\)"),
    D("go-empty-error-check", "high", "quality", "Empty error check: Error is checked but not handled", r"if\s+err\s*!=\s*nil\s*\{\s*\}"),
    D("go-empty-interface", "info", "quality", "Empty interface: Consider using generics (Go 1.18+) or specific types", r"interface\s*\{\s*\}"),
)
JAVA = (
    D("java-sql-concat", "critical", "security", "Potential SQL injection: String concatenation in SQL query", r"(Statement|createStatement|executeQuery|executeUpdate|execute)\s*\([^)]*\+[^)]*\)"),
    D("java-sql-format", "critical", "security", "Potential SQL injection: String.format() in SQL query", r"(executeQuery|executeUpdate|execute)\s*\(\s*String\.format\s*\("),
    D("java-read-object", "critical", "security", "Insecure deserialization: readObject() without validation", r"ObjectInputStream\s*\([^)]*\)\.readObject\(\)"),
    D("java-xml-decoder", "high", "security", "Insecure deserialization: XMLDecoder can execute arbitrary code", r"new\s+XMLDecoder\s*\("),
    D("java-path-file", "high", "security", "Path traversal: File path from user input without validation", r"new\s+File\s*\([^)]*request\.getParameter[^)]*\)"),
    D("java-path-stream", "high", "security", "Path traversal: FileInputStream with user-controlled path", r"new\s+FileInputStream\s*\([^)]*request\."),
    D("java-ssrf-url", "high", "security", "SSRF: URL constructed from user input", r"new\s+URL\s*\([^)]*request\.getParameter[^)]*\)"),
    D("java-ssrf-client", "high", "security", "SSRF: HTTP request with user-controlled URL", r"HttpClient.*\.execute\s*\([^)]*request\.", "s"),
    D("java-ssl", "high", "security", "Insecure SSL/TLS: Using deprecated SSL protocol", r"""SSLContext\.getInstance\s*\(\s*["']SSL["']"""),
    D("java-exec", "critical", "security", "Command injection: Runtime.exec() with string concatenation", r"Runtime\.getRuntime\(\)\.exec\s*\([^)]*\+[^)]*\)"),
    D("java-password", "high", "security", "Hardcoded password detected", r"""(password|passwd|pwd)\s*=\s*["'][^"']{8,}["']""", "i"),
    D("java-api-key", "critical", "security", "Hardcoded API key detected", r"""(api[_-]?key|apikey|access[_-]?key)\s*=\s*["'][A-Za-z0-9]{20,}["']""", "i"),
    D("java-catch-exception", "medium", "quality", "Catching generic Exception - too broad", r"catch\s*\(\s*Exception\s+\w+\s*\)"),
    D("java-catch-throwable", "high", "quality", "Catching Throwable - catches errors that should not be caught", r"catch\s*\(\s*Throwable\s+\w+\s*\)"),
    D("java-swallow", "medium", "quality", "Swallowing exception - only comment in catch block", r"catch\s*\([^)]+\)\s*\{\s*//[^\n]*\n\s*\}"),
    D("java-throws-exception", "low", "quality", "Throwing generic Exception", r"throws?\s+Exception\b"),
    D("java-null-check", "info", "quality", "Null check with == - consider using Objects.isNull()", r"if\s*\(\s*\w+\s*==\s*null\s*\)"),
    D("java-stack-trace", "medium", "quality", "Using printStackTrace() - not suitable for production", r"\.printStackTrace\s*\(\s*\)"),
    D("java-finalize", "high", "quality", "finalize() is deprecated and unreliable", r"protected\s+void\s+finalize\s*\(\s*\)"),
    D("java-date", "low", "quality", "Using legacy Date class", r"new\s+Date\s*\("),
    D("java-vector", "low", "quality", "Using legacy Vector class", r"new\s+Vector\s*<"),
    D("java-hashtable", "low", "quality", "Using legacy Hashtable class", r"new\s+Hashtable\s*<"),
    D("java-sync-string", "high", "concurrency", "Synchronizing on String literal - can cause deadlock", r'synchronized\s*\(\s*"[^"]*"\s*\)'),
    D("java-sync-boxed", "high", "concurrency", "Synchronizing on boxed primitive - can cause deadlock", r"synchronized\s*\(\s*(Integer|Long|Boolean|Double|Float|Short|Byte|Character)\."),
    D("java-sync-empty", "medium", "concurrency", "Empty synchronized block - unnecessary overhead", r"synchronized\s*\([^)]+\)\s*\{\s*\}"),
    D("java-date-format", "high", "concurrency", "SimpleDateFormat is not thread-safe", r"(private|protected|public)\s+(static\s+)?SimpleDateFormat"),
    D("java-calendar", "medium", "concurrency", "Calendar is not thread-safe", r"(private|protected|public)\s+(static\s+)?Calendar"),
    D("java-nested-sync", "medium", "concurrency", "Nested synchronized blocks - potential deadlock", r"synchronized\s*\([^)]+\)\s*\{[^}]*synchronized\s*\([^)]+\)", "s"),
    D("java-volatile-array", "medium", "concurrency", "Volatile array: Only reference is volatile, not array elements", r"volatile\s+\w+\[\]"),
    D("java-concat-loop", "medium", "performance", "String concatenation in loop - creates many temporary objects", r"for\s*\([^)]+\)\s*\{[^}]*\+\s*=\s*[^}]*\}", "s"),
    D("java-boxing", "low", "performance", "Unnecessary boxing of primitive value", r"(Integer|Long|Double|Float|Boolean|Character|Byte|Short)\.valueOf\s*\(\s*\d+\s*\)"),
    D("java-parallel-stream", "low", "performance", "parallelStream() has overhead - only beneficial for large collections", r"\.parallelStream\(\)"),
    D("java-pattern-loop", "high", "performance", "Pattern.compile() in loop - expensive operation", r"(for|while)\s*\([^)]+\)\s*\{[^}]*Pattern\.compile\(", "s"),
    D("java-empty-catch", "medium", "performance", "Empty catch block - exceptions are expensive", r"catch\s*\([^)]+\)\s*\{\s*\}"),
    D("java-try-loop", "medium", "performance", "Try-catch in loop - exceptions are expensive", r"(for|while)\s*\([^)]+\)\s*\{[^}]*try\s*\{[^}]*\}\s*catch", "s"),
    D("java-reflection-loop", "high", "performance", "Reflection in loop - very expensive operation", r"(for|while)\s*\([^)]+\)\s*\{[^}]*(Class\.forName|Method\.invoke|Field\.get|Constructor\.newInstance)", "s"),
    D("java-new-string", "low", "performance", "Unnecessary String object creation", r'new\s+String\s*\(\s*"[^"]*"\s*\)'),
    D("java-boolean-value", "low", "performance", "Unnecessary Boolean object creation", r"Boolean\.valueOf\s*\(\s*(true|false)\s*\)"),
)
JAVASCRIPT = (
    D("js-inner-html", "high", "security", "Potential XSS vulnerability: innerHTML assignment without sanitization", r"""\.innerHTML\s*=\s*(?!['"<])"""),
    D("js-dangerous-html", "high", "security", "Potential XSS: dangerouslySetInnerHTML used", r"dangerouslySetInnerHTML\s*=\s*\{\{?\s*__html:"),
    D("js-document-write", "medium", "security", "Potential XSS: document.write() can introduce XSS vulnerabilities", r"document\.write(?:ln)?\s*\("),
    D("js-sql-concat", "critical", "security", "Potential SQL injection: string concatenation in SQL query", r"(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\s+.*?\+\s*\w+", "i"),
    D("js-sql-template", "critical", "security", "Potential SQL injection: string concatenation in SQL query", r"(?:SELECT|INSERT|UPDATE|DELETE|FROM|WHERE)\s+.*?\$\{", "i"),
    D("js-query-template", "critical", "security", "Potential SQL injection: string concatenation in SQL query", r"""\.query\s*\(\s*[`"'].*?\$\{""", "i"),
    D("js-execute-concat", "critical", "security", "Potential SQL injection: string concatenation in SQL query", r"""\.execute\s*\(\s*[`"'].*?\+""", "i"),
    D("js-command-template", "critical", "security", "Potential command injection: user input in shell command", r"""(?:exec|spawn|execSync|execFile)\s*\(\s*[`"'].*?\$\{"""),
    D("js-command-concat", "critical", "security", "Potential command injection: user input in shell command", r"(?:exec|spawn|execSync|execFile)\s*\(\s*.*?\+"),
    D("js-eval", "critical", "security", "Dangerous use of eval(): can execute arbitrary code", r"\beval\s*\("),
    D("js-function", "high", "security", "Dangerous use of Function constructor: similar to eval()", r"new\s+Function\s*\("),
    D("js-proto-index", "high", "security", "Potential prototype pollution: unsafe property access", r"\[.*?(?:__proto__|constructor|prototype)\]"),
    D("js-proto-member", "high", "security", "Potential prototype pollution: unsafe property access", r"\.(?:__proto__|constructor\.prototype)"),
    D("js-path", "high", "security", "Potential path traversal: user input in file path", r"(?:readFile|writeFile|unlink|rmdir|mkdir|open)\s*\(\s*.*?(?:req\.|params\.|query\.)"),
    D("js-redirect", "medium", "security", "Potential open redirect: user input in redirect URL", r"(?:redirect|location\.href|window\.location)\s*=?\s*.*?(?:req\.|params\.|query\.)"),
    D("js-weak-hash", "medium", "security", "Weak cryptographic hash: MD5/SHA1 are not secure", r"""createHash\s*\(\s*["'](?:md5|sha1)["']"""),
    D("js-api-key", "critical", "security", "Hardcoded api key detected", r"""(?:api[_-]?key|apikey)\s*[:=]\s*["'][a-zA-Z0-9]{20,}["']""", "i"),
    D("js-password", "critical", "security", "Hardcoded password detected", r"""(?:password|passwd|pwd)\s*[:=]\s*["'][^"']{8,}["']""", "i"),
    D("js-token", "critical", "security", "Hardcoded secret/token detected", r"""(?:secret|token)\s*[:=]\s*["'][a-zA-Z0-9]{20,}["']""", "i"),
    D("js-aws", "critical", "security", "Hardcoded aws credentials detected", r"(?:aws|amazon).*?(?:key|secret)", "i"),
    D("js-regex-built", "medium", "security", "Potentially unsafe regex: may be vulnerable to ReDoS attacks", r"new\s+RegExp\s*\([^)]*\([^)]*\+[^)]*\)"),
    D("js-regex-plus", "medium", "security", "Potentially unsafe regex: may be vulnerable to ReDoS attacks", r"/\([^)]*\+[^)]*\)\+/"),
    D("js-regex-star", "medium", "security", "Potentially unsafe regex: may be vulnerable to ReDoS attacks", r"/\([^)]*\*[^)]*\)\+/"),
    D("js-xxe", "high", "security", "Potential XXE vulnerability: XML parsing without entity protection", r"(?:parseXml|DOMParser|xml2js).*?(?:parse|parseString)"),
    D("js-empty-catch", "medium", "smell", "Empty catch block swallows exceptions", r"catch\s*\([^)]*\)\s*\{\s*\}", "m"),
    D("js-nested-ternary", "low", "smell", "Nested ternary operators reduce readability", r"\?[^:?\n]+\?[^:\n]+:[^:\n]+:"),
    D("js-console", "info", "smell", "Console statement found", r"\bconsole\.(log|debug|info|warn|error)\s*\("),
    D("js-var", "low", "standards", "Use 'let' or 'const' instead of 'var'", r"\bvar\s+\w+"),
    D("js-json-parse", "medium", "performance", "Large JSON.parse() operation may block event loop", r"JSON\.parse\s*\([^)]{100,}\)"),
    D("js-lodash", "medium", "performance", "Importing entire lodash library increases bundle size", r"""import\s+(?:_|\*\s+as\s+_)\s+from\s+["']lodash["']"""),
    D("js-moment", "low", "performance", "moment.js is large (67KB): consider lighter alternatives", r"""import\s+moment\s+from\s+["']moment["']"""),
    D("js-n-plus-one-for", "high", "performance", "Potential N+1 query: database/API call inside loop", r"for\s*\([^)]+\)\s*\{[^}]*(?:fetch|axios|query|findOne|findById)\s*\(", "s"),
    D("js-n-plus-one-each", "high", "performance", "Potential N+1 query: database/API call inside loop", r"\.forEach\s*\([^)]*\{[^}]*(?:fetch|axios|query|findOne|findById)\s*\(", "s"),
    D("js-n-plus-one-map", "high", "performance", "Potential N+1 query: database/API call inside loop", r"\.map\s*\([^)]*\{[^}]*(?:fetch|axios|query|findOne|findById)\s*\(", "s"),
    D("js-inline-function", "low", "performance", "Inline function in JSX prop causes unnecessary re-renders", r"(?:onClick|onChange|onSubmit|on\w+)\s*=\s*\{(?:\([^)]*\)\s*=>|\s*function)"),
    D("js-use-effect", "medium", "performance", "useEffect without dependency array runs on every render", r"useEffect\s*\(\s*\([^)]*\)\s*=>\s*\{[^}]*\}\s*\)"),
    D("js-concat-loop", "medium", "performance", "String concatenation in loop creates new string each iteration", r"""for\s*\([^)]+\)\s*\{[^}]*\+=\s*["']""", "s"),
)
TYPESCRIPT = (
    D("ts-any", "medium", "type_safety", 'Use of "any" type defeats TypeScript type checking', r":\s*any\b"),
    D("ts-any-array", "medium", "type_safety", 'Array of "any" type: no type safety for array elements', r":\s*any\[\]"),
    D("ts-instanceof-array", "low", "type_safety", "Use Array.isArray() instead of instanceof Array", r"instanceof\s+Array"),
    D("ts-assertion", "low", "type_safety", "Type assertion bypasses type checking", r"\bas\s+\w+", unless_line="as const"),
    D("ts-old-assertion", "low", "type_safety", 'Old-style type assertion: use "as Type" instead', r"<\w+>", unless_line="</|return <|= <"),
    D("ts-non-null", "medium", "type_safety", "Non-null assertion (!) can cause runtime errors if value is null/undefined", r"\w+!(?!=)"),
    D("ts-return-type", "low", "type_safety", "Function missing return type annotation", r"function\s+\w+\s*\([^)]*\)\s*\{", unless_line=r":[^)]*$|^[^)]*$"),
    D("ts-arrow-return-type", "low", "type_safety", "Function missing return type annotation", r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?\([^)]*\)\s*=>\s*\{", unless_line=r":[^)]*$|^[^)]*$"),
    D("ts-parameter-types", "medium", "type_safety", "Function parameters missing type annotations", r"function\s+\w+\s*\((?=\s*[^\s)])[^):]+\)"),
    D("ts-coercion", "low", "type_safety", "Potential unsafe type coercion with + operator", r"""^.*(?:\+\s*["']|["'].*?\+).*$""", "m"),
    D("ts-double-negation", "info", "type_safety", "Double negation (!!) for boolean coercion is unclear", r"!!\w+"),
)
#: Rust types that are copied, and those that need no box.
_COPIED = ("i8", "i16", "i32", "i64", "i128", "isize", "u8", "u16", "u32", "u64", "u128", "usize", "f32", "f64", "bool", "char")
_SMALL = ("i32", "u32", "i64", "u64", "f32", "f64", "bool", "char")
RUST = (
    D("rust-moved-let", "high", "ownership", "Potential move violation: Variable potentially used after move", r"let\s+\w+\s*=\s*(\w+);.*\n.*\1\.", "m"),
    D("rust-moved-into", "high", "ownership", "Potential move violation: Variable used after .into() (move)", r"(\w+)\.into\(\).*\n.*\1\.", "m"),
    D("rust-moved-consume", "high", "ownership", "Potential move violation: Variable used after being consumed", r"consume\((\w+)\).*\n.*\1\.", "m"),
    D("rust-borrow-moved-let", "critical", "ownership", "Attempting to borrow after move", r"let\s+\w+\s*=\s*(\w+);\s*\n\s*let\s+\w+\s*=\s*&\1", "m"),
    D("rust-borrow-moved-into", "critical", "ownership", "Attempting to borrow after move", r"(\w+)\.into\(\);\s*\n\s*&\1", "m"),
    D("rust-two-mutable", "critical", "ownership", "Multiple mutable borrows of the same variable", r"let\s+\w+\s*=\s*&mut\s+(\w+);\s*\n\s*let\s+\w+\s*=\s*&mut\s+\1", "m"),
    D("rust-mutable-shared", "critical", "ownership", "Mutable borrow while immutable borrow exists", r"let\s+\w+\s*=\s*&(\w+);\s*\n\s*let\s+\w+\s*=\s*&mut\s+\1", "m"),
    D("rust-dangling-local", "critical", "ownership", "Potential dangling reference: Returning reference to local variable", r"fn\s+\w+.*->\s*&.*\{[^}]*let\s+(\w+)\s*=.*\n[^}]*&\1", "ms"),
    D("rust-dangling-temporary", "critical", "ownership", "Potential dangling reference: Reference to temporary value", r"&\w+\s*\{[^}]*let\s+(\w+)\s*=.*\n[^}]*\1", "ms"),
    D("rust-lifetime", "medium", "ownership", "Function with references may need explicit lifetime annotations", r"fn\s+\w+\s*\([^)]*&[^')]*\)\s*->\s*&[^'{\n]*\{", unless_line="'.*<|<.*'"),
    *(D(f"rust-clone-{t}", "low", "ownership", f"Unnecessary .clone() on Copy type {t}", rf":\s*{t}\s*=.*\.clone\(\)") for t in _COPIED),
    D("rust-clone-once", "medium", "ownership", "Potentially unnecessary clone: value used only once", r"let\s+(\w+)\s*=\s*(\w+)\.clone\(\);\s*\n[^}]*\1\s*[;\)]", "m"),
    D("rust-rc-refcell", "info", "ownership", "Rc<RefCell<T>> pattern detected", r"Rc<RefCell<"),
    D("rust-arc-mutex", "low", "ownership", "Arc<Mutex<T>> in potentially single-threaded context", r"Arc<Mutex<", "", 500, ("thread",), behind=True, unless_line="async"),
    D("rust-clone-loop", "high", "performance", "Cloning inside loop - can cause significant allocations", r"for\s+\w+\s+in\s+[^{]+\{[^}]*\.clone\(\)", "s"),
    D("rust-clone-twice", "medium", "performance", "Multiple clones of same value", r"(\w+)\.clone\(\).*\n.*\1\.clone\(\)", "m"),
    D("rust-to-string-loop", "high", "performance", "String allocation (.to_string()) inside loop", r"for\s+\w+\s+in\s+[^{]+\{[^}]*\.to_string\(\)", "s"),
    D("rust-string-from", "low", "performance", "String::from() allocates - consider if &str would work", r"String::from\([^)]+\)\s*(?:;|\))", unless_line="->|fn "),
    D("rust-string-plus", "medium", "performance", "String concatenation with + creates multiple allocations", r'"\s*\+\s*&?\w+\s*\+\s*"'),
    D("rust-vec-capacity", "medium", "performance", "Vec::new() without capacity before loop - causes reallocations", r"let\s+mut\s+(\w+)\s*=\s*Vec::new\(\);\s*\n\s*for\s+[^{]+\{[^}]*\1\.push\(", "ms"),
    D("rust-pushes", "low", "performance", "Multiple pushes without pre-allocated capacity", r"Vec::new\(\);\s*\n(?:\s*\w+\.push\([^)]+\);\s*\n){3,}", "m"),
    D("rust-iter-collect", "low", "performance", ".iter().map().collect() - consider into_iter() if ownership not needed", r"\.iter\(\)\.map\([^)]+\)\.collect\(\)"),
    D("rust-collect-len", "medium", "performance", "Collecting to Vec just to get length - use .count() instead", r"\.collect::<Vec<[^>]+>>.*\.len\(\)"),
    D("rust-manual-filter", "info", "performance", "Manual filtering in loop - consider .filter().collect()", r"for\s+\w+\s+in\s+[^{]+\{[^}]*if\s+[^{]+\{[^}]*\.push\(", "s"),
    D("rust-collect-iter", "high", "performance", "Unnecessary .collect() followed by .iter() - removes lazy evaluation", r"\.collect::<Vec<[^>]+>>\(\)\.iter\(\)"),
    D("rust-await-loop", "high", "performance", "Sequential .await in loop - no concurrency", r"for\s+\w+\s+in\s+[^{]+\{[^}]*\.await", "s"),
    D("rust-async-sleep", "high", "performance", "Blocking operation in async context: thread::sleep in async function", r"async\s+fn\s+\w+[^{]*\{[^}]*std::thread::sleep", "s"),
    D("rust-async-lock", "high", "performance", "Blocking operation in async context: Mutex::lock in async (use tokio::sync::Mutex)", r"async\s+fn\s+\w+[^{]*\{[^}]*\.lock\(\)\.unwrap\(\)", "s"),
    D("rust-lock-await", "critical", "performance", "Mutex lock held across .await - can cause deadlocks", r"\.lock\(\)[^;]*\.await"),
    D("rust-format-loop", "medium", "performance", "format! macro in loop - allocates on each iteration", r"for\s+\w+\s+in\s+[^{]+\{[^}]*format!\(", "s"),
    *(D(f"rust-box-{t}", "low", "performance", f"Unnecessary Box<{t}> - adds heap allocation overhead", rf"Box<{t}>") for t in _SMALL),
    D("rust-unsafe-fn", "high", "safety", "Unsafe function detected", r"unsafe\s+fn\s+\w+"),
    D("rust-unwrap-default", "info", "safety", "Use of .unwrap_or_default() - consider explicit default", r"\.unwrap_or_default\(\)"),
    D("rust-ffi", "high", "safety", "FFI function detected - requires careful safety review", r'extern\s+"C"\s+fn'),
    D("rust-transmute", "critical", "safety", "std::mem::transmute is extremely unsafe", r"transmute[:<]"),
    D("rust-raw-pointer", "high", "safety", "Raw pointer dereference detected", r"\*\s*\w+\s*as\s*\*(?:const|mut)"),
    D("rust-uninit", "critical", "safety", "Uninitialized memory - must be initialized before use", r"MaybeUninit::uninit\(\)"),
    D("rust-uninitialized", "critical", "safety", "Deprecated uninitialized() - use MaybeUninit instead", r"mem::uninitialized\(\)"),
    D("rust-todo", "high", "safety", "todo! macro - code not yet implemented (panics)", r"todo!\("),
    D("rust-unimplemented", "high", "safety", "unimplemented! macro - panics when called", r"unimplemented!\("),
    D("rust-ok-ignored", "low", "quality", "Converting Result to Option with .ok() and ignoring", r"\.ok\(\)\s*;"),
    D("rust-is-some-unwrap", "medium", "quality", ".is_some() check followed by .unwrap() - use if let instead", r"if\s+\w+\.is_some\(\)[^}]*\w+\.unwrap\(\)", "s"),
    D("rust-len-zero", "low", "quality", "Use .is_empty() instead of .len() == 0", r"\.len\(\)\s*==\s*0"),
    D("rust-equals-true", "low", "quality", "Comparing boolean to true is redundant", r"if\s+\w+\s*==\s*true"),
    D("rust-return-end", "info", "quality", "Unnecessary return at end of function", r"\n\s+return\s+[^;]+;\s*\n\s*\}"),
)
BY_LANGUAGE = {"go": GO, "java": JAVA, "javascript": JAVASCRIPT, "typescript": JAVASCRIPT + TYPESCRIPT, "rust": RUST}
#: The same by table: JavaScript's detectors are for TypeScript, too.
_FOR = ((GO, ("go",)), (JAVA, ("java",)), (JAVASCRIPT, ("javascript", "typescript")), (TYPESCRIPT, ("typescript",)), (RUST, ("rust",)))

_EMPTY = "cast(array() AS array<struct<detector:string,severity:string,category:string,message:string,line_start:bigint,col:bigint,matched:string>>)"


def _found(d: Detector, text: str) -> Column:
    found = regex.matches(text, d.java_pattern())
    if d.around:
        def near(m: Column) -> Column:
            start = F.greatest(m["start"] - d.around, F.lit(0))
            end = m["start"] if d.behind else m["start"] + F.length(m["text"]) + d.around
            window = F.substring(F.col(text), start + 1, end - start)
            ok = F.lit(True)
            for w in d.unless:
                ok = ok & ~F.contains(window, F.lit(w))
            if d.only_if:
                there = F.lit(False)
                for w in d.only_if:
                    there = there | F.contains(window, F.lit(w))
                ok = ok & there
            return ok

        found = F.filter(found, near)
    if d.unless_line:
        found = F.filter(found, lambda m: ~F.get(F.split(F.col(text), "\n", -1), (m["line"] - 1).cast("int")).rlike(d.unless_line))
    said = [F.lit(x).alias(n) for n, x in (("detector", d.id), ("severity", d.severity), ("category", d.category), ("message", d.message))]
    return F.coalesce(F.transform(found, lambda m: F.struct(*said, m["line"].cast("long").alias("line_start"), m["col"].cast("long").alias("col"), m["text"].alias("matched"))), F.expr(_EMPTY))


def detect(files: DataFrame, text: str = "content", keep: tuple[str, ...] = ("file_path",), languages: Iterable[str] = tuple(BY_LANGUAGE)) -> DataFrame:
    """Findings of all detectors of each file's language; ``files`` has ``keep``, language and ``text``."""
    # One scan: each row meets the detectors of its own language only, and each detector is planned once.
    languages = tuple(languages)
    parts = []
    for table, meant in _FOR:
        if own := [x for x in meant if x in languages]:
            parts.append(F.when(F.col("language").isin(*own), F.concat(*[_found(d, text) for d in table])).otherwise(F.expr(_EMPTY)))
    found = F.concat(*parts)
    own = files.where(F.col("language").isin(*languages)).select(*keep, "language", F.explode(found).alias("m"))
    return own.select(*keep, "language", "m.*")
