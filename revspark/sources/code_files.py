"""``code_files(doc_id, review_id, file, content)`` derived from ``documents``.

The driver gives no source-code table, so a deterministic corpus of Java /
C++ / Python / JS / Go files is derived from each document's id, source and
text (FIXTURES.md B1): methods from the templates, and after them every line
of the document's text as a comment line, so a file is as long as its
document.  The derivation is a pure per-row projection: the template
dictionary is a literal map (about 50 entries, fixed size), so no join and no
shuffle happen - on 100 TB of documents this is a map-only stage.

``oracle_code_files_sql`` emits the same derivation as DuckDB SQL for the
correctness oracle; both are generated from the single template block below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revspark.sources.tables import table

# The fixture templates (FIXTURES.md B1), one per line as
# "ext idx|body"; "~" is a line break, "$v" a variable name, "$n" the chunk no.
TEMPLATES_TEXT = r"""
java 0|  public long meter$n(File log) throws Exception {~    FileChannel $v = FileChannel.open(log, "r//w");~    long seen = $v.size();~    return seen;~  }
java 1|  public int peek$n(Socket line) throws Exception {~    try (Reader $v = wrap(line)) {~      return $v.read();~    }~  }
java 2|  public void drain$n(Socket line) throws Exception {~    BufferedWriter $v = wrap(line);~    $v.flush();~    $v.close();~  }
java 3|  public int width$n() {~    StringBuilder $v = null;~    return $v.capacity();~  }
java 4|  public int safeWidth$n() {~    StringBuilder $v = null;~    int w = 0;~    if ($v != null) w = $v.capacity();~    return w;~  }
java 5|  public void arrive$n() {~    visits += 2;~  }
java 6|  public void enrol$n(String badge, String desk) {~    if (desks.get(badge) == null) {~      audit(badge);~      desks.put(badge, desk);~    }~  }
java 7|  public Map<String,String> directory$n() {~    audit("read");~    return desks;~  }
java 8|  public void recall$n(int[] codes) {~    for (int q = 0; q < codes.length; q++) {~      Badge b = badgeRepository.findByCode(codes[q]);~      audit(b);~    }~  }
java 9|  public Object roster$n(List<Integer> codes) {~    return codes.stream().map(c -> badgeRepository.findByCode(c)).toList();~  }
java 10|  public void nest$n(List<String> ids) {~    for (String a : ids) {~      while (more(a)) {~        badgeRepository.save(a);~      }~    }~  }
java 11|  public void prune$n(Statement st, String $v) throws Exception {~    st.executeUpdate("delete from badges where code = " + $v);~  }
java 12|  public void sqlok$n(Statement st) throws Exception {~    st.executeQuery("select 1 + 1");~  }
java 13|  public void secret$n() {~    String password = "p$n-$v";~    /* apiKey = "not code" */~  }
java 14|  public void scanRow$n(String grid) {~    for (int row = 0; row <= grid.length(); row++) {~      audit(grid.charAt(row));~    }~  }
java 15|  public synchronized void sync$n() {~    visits = visits + 1;~  }
java 16|  public int probe$n(String path) throws Exception {~    FileReader r = new FileReader(path);~    int b = 4;~    return b;~  }
java 17|  public void maybe$n(boolean done) throws Exception {~    FileInputStream $v = new FileInputStream("c");~    if (done) {~      $v.close();~    }~  }
java 18|  public int pick$n(boolean vip) {~    String $v = null;~    if (vip) {~      $v = "gold";~    }~    return $v.length();~  }
java 19|  public void tell$n() {~    String $v = null;~    if ($v == null) {~      audit("none");~    }~    audit($v.trim());~  }
java 20|  public void quiet$n() {~    String $v = null;~    if ($v == null) {~      return;~    }~    audit($v.trim());~  }
java 21|  private long limit$n = 60 * SPAN;~  public long span$n() {~    return SPAN + 1;~  }
java 22|  public boolean over$n(int n) {~    return n > visits;~  }
java 23|  public void sweep$n(List<String> ids, boolean dry) {~    for (String id : ids)~      if (!dry) {~        badgeRepository.findOne(id);~        badgeRepository.deleteAll(id);~      }~  }
java 24|  public void pages$n(List<String> qs) {~    for (String q : qs) {~      badgeRepository.queryFor(q).getRows();~    }~  }
java 25|  public void tiny$n() { int a = 1; audit(a); }
java 26|  public void shut$n(boolean done) throws Exception {~    FileInputStream $v = new FileInputStream("c");~    try {~      audit($v.read());~    } finally {~      if (done) $v.close();~    }~  }
java 27|  public void either$n(boolean done) throws Exception {~    Reader $v = open("e");~    if (done) {~      $v.close();~    } else {~      audit("late");~      $v.close();~    }~  }
java 28|  public void early$n(boolean bad) throws Exception {~    Reader $v = open("f");~    if (bad) {~      return;~    }~    $v.close();~  }
java 29|  public int given$n(boolean vip) {~    String $v = null;~    if (vip) {~      $v = "gold";~    } else {~      $v = "tin";~    }~    return $v.length();~  }
java 30|  public void round$n(String $v) {~    for (int i = 0; i < 3; i++) { audit($v.trim()); $v = null; }~  }
java 31|  public void refuse$n(int k) throws Exception {~    Reader $v = open("g");~    if (k < 0) throw new IllegalStateException();~    else if (k == 0) $v.close();~    else {~      $v.close();~    }~  }
java 32|  public void cases$n(int k) throws Exception {~    Reader $v = open("h");~    switch (k) {~      case 1: $v.close(); break;~      default: audit("none");~    }~  }
java 33|  public void nested$n(boolean a, boolean b) throws Exception {~    Reader $v = open("i");~    if (a) {~      if (b) {~        $v.close();~      } else {~        $v.close();~      }~    } else {~      $v.close();~    }~  }
java 34|  public int again$n(int k) {~    String $v = null;~    while (k > 0) {~      if (k == 7) break;~      $v = "seven";~      k--;~    }~    return $v.length();~  }
java 35|  public int once$n(int k) {~    String $v = null;~    do {~      $v = "set";~    } while (k > 1);~    return $v.length();~  }
cpp 0|void a$n() {~  FILE* $v = fopen("x", "r");~  puts("open http://x");~}
cpp 1|void b$n() {~  char* $v = malloc(8);~  free($v);~}
cpp 2|void c$n() {~  T* $v = nullptr;~  $v->run();~}
cpp 3|void d$n() {~  T* $v = NULL;~  if ($v) $v->run();~}
cpp 4|void e$n() {~  for (int i = 0; i < 3; i++) {~    db.query(i);~  }~}
cpp 5|/* note~ * $v-> in comment~ */~int f$n() { return 0; }
cpp 6|void g$n() {~  while (next()) {~    // db.execute(1)~    db.execute(2);~  }~}
py 0|def a$n():~    $v = open("f")~    return $v.read()
py 1|def b$n():~    $v = open("f")~    $v.close()
py 2|def c$n():~    $v = None~    return $v.name
py 3|def d$n():~    $v = None~    if $v is not None:~        return $v.name
py 4|def e$n(db, ids):~    for i in ids:~        db.execute("q")  # db.
py 5|def f$n():~    x = 1~    y = 2~    return x + y
js 0|function a$n() {~  let $v = null;~  return $v.name;~}
js 1|function b$n() {~  let $v = undefined;~  return $v?.name;~}
js 2|async function c$n(ids) {~  for (const i of ids) {~    await load(i);~  }~}
js 3|function d$n(ids) {~  return ids.map(i =>~    fetch("/x/" + i));~}
js 4|function e$n() {~  // fetch(1)~  return 1;~}
js 5|function f$n() {~  let $v = null;~  if (ok) $v.run();~}
js 6|function g$n(rows) {~  rows.forEach(r => {~    db.save(r);~  });~}
go 0|func a$n() {~  for i := 0; i < 3; i++ {~    rows := conn.query(i)~  }~}
go 1|func b$n() {~  x := 1~  use(x)~}
go 2|func c$n() {~  sql := "select 1"~  use(sql)~}
"""

# Extension by doc_id % 5, and the per-language header/footer.
EXTS = ["java", "cpp", "py", "js", "go"]
JAVA_HEADER_TOP = "import java.util.*;~"
JAVA_HEADER_SERVICE = "@Service~"
JAVA_HEADER_CLASS = (
    "public class F$d {~  private long visits;~"
    "  private Map<String,String> desks = new TreeMap<>();~"
    "  private BadgeRepository badgeRepository;"
)
#: The method that holds the text: its head, what stands before and after each line, and its end with the class's.
JAVA_NOTES = ("  public void notes() {\n", '    audit("', '");', "\n  }\n}")
#: Characters that would end or escape a string literal, and what they become.
LITERAL_FROM, LITERAL_TO = '"\\', "'/"
# review_id groups code files into reviews of ten files (our own choice).
FILES_PER_REVIEW = 10


def templates() -> list[tuple[str, int, str]]:
    out = []
    for line in TEMPLATES_TEXT.strip("\n").splitlines():
        head, body = line.split("|", 1)
        ext, idx = head.split(" ")
        out.append((ext, int(idx), body))
    return out


def template_counts() -> dict[str, int]:
    counts: dict[str, int] = {}
    for ext, _, _ in templates():
        counts[ext] = counts.get(ext, 0) + 1
    return counts


def _count_expr(ext: Column) -> Column:
    expr = None
    for name, n in template_counts().items():
        expr = F.when(ext == name, F.lit(n)) if expr is None else expr.when(ext == name, F.lit(n))
    return expr


def code_files_from_documents(docs: DataFrame) -> DataFrame:
    """Per-row projection documents(doc_id, source, text) -> code_files."""
    tmap = F.create_map(*[x for e, i, b in templates() for x in (F.lit(f"{e}:{i}"), F.lit(b))])
    d = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("doc_id") % 5 + 1).cast("int"))
    d = d.withColumn("ext", ext).withColumn("n_tpl", _count_expr(F.col("ext")))
    chunks = F.transform(
        F.sequence(F.lit(0).cast("long"), 1 + F.floor(F.col("doc_id") / 5) % 6),
        lambda k: F.replace(
            F.element_at(
                tmap,
                F.concat(
                    F.col("ext"), F.lit(":"),
                    ((F.col("doc_id") * 31 + k * k * 17 + k) % F.col("n_tpl")).cast("string"),
                ),
            ),
            F.lit("$n"),
            k.cast("string"),
        ),
    )
    header = (
        F.when(
            F.col("ext") == "java",
            F.concat(
                F.lit(JAVA_HEADER_TOP),
                F.when(F.col("doc_id") % 2 == 0, F.lit(JAVA_HEADER_SERVICE)).otherwise(F.lit("")),
                F.lit(JAVA_HEADER_CLASS),
            ),
        )
        .when(F.col("ext") == "py", F.lit("# F$d"))
        .otherwise(F.lit("// F$d"))
    )
    raw = F.concat_ws("~", header, F.array_join(chunks, "~"), F.lit(""))
    content = F.replace(
        F.replace(
            F.replace(raw, F.lit("$d"), F.col("doc_id").cast("string")),
            F.lit("$v"),
            F.concat(F.lit("v"), (F.col("doc_id") % 7).cast("string")),
        ),
        F.lit("~"),
        F.lit("\n"),
    )
    mark = F.when(F.col("ext") == "py", F.lit("# ")).otherwise(F.lit("// "))
    comments = F.concat(F.lit("\n"), mark, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), mark)))
    head, before, after, end = JAVA_NOTES
    literals = F.replace(F.translate("text", LITERAL_FROM, LITERAL_TO), F.lit("\n"), F.lit(f"{after}\n{before}"))
    notes = F.concat(F.lit(head + before), literals, F.lit(after + end))
    content = F.concat(content, F.when(F.col("ext") == "java", notes).otherwise(comments))
    file = F.concat(F.lit("src/"), F.col("source"), F.lit("/F"), F.col("doc_id").cast("string"),
                    F.lit("."), F.col("ext"))
    return d.select(
        F.col("doc_id"),
        F.floor(F.col("doc_id") / FILES_PER_REVIEW).cast("long").alias("review_id"),
        file.alias("file"),
        content.alias("content"),
    )


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_files_from_documents(table(spark, sf_dir, "documents"))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_code_files_sql() -> str:
    """DuckDB CTE body producing the same ``code_files`` table."""
    values = ",\n".join(f"({_sql_str(e)}, {i}, {_sql_str(b)})" for e, i, b in templates())
    counts = " ".join(f"WHEN {_sql_str(e)} THEN {n}" for e, n in template_counts().items())
    ext_list = "[" + ", ".join(_sql_str(e) for e in EXTS) + "]"
    java_header = (
        f"{_sql_str(JAVA_HEADER_TOP)} || CASE WHEN d.doc_id % 2 = 0 THEN {_sql_str(JAVA_HEADER_SERVICE)} "
        f"ELSE '' END || {_sql_str(JAVA_HEADER_CLASS)}"
    )
    head, before, after, end = JAVA_NOTES
    return f"""
SELECT doc_id, review_id, file,
       replace(replace(replace(raw, '$d', CAST(doc_id AS VARCHAR)), '$v', 'v' || CAST(doc_id % 7 AS VARCHAR)), '~', chr(10))
         || CASE ext WHEN 'java' THEN {_sql_str(head + before)} || replace(translate(text, {_sql_str(LITERAL_FROM)}, {_sql_str(LITERAL_TO)}), chr(10), {_sql_str(after)} || chr(10) || {_sql_str(before)})
                                      || {_sql_str(after + end)}
                     ELSE chr(10) || mark || replace(text, chr(10), chr(10) || mark) END AS content
FROM (
  SELECT d.doc_id, d.ext, any_value(d.text) AS text, CASE d.ext WHEN 'py' THEN '# ' ELSE '// ' END AS mark, d.doc_id // {FILES_PER_REVIEW} AS review_id,
         'src/' || d.source || '/F' || CAST(d.doc_id AS VARCHAR) || '.' || d.ext AS file,
         CASE d.ext WHEN 'java' THEN {java_header} WHEN 'py' THEN '# F$d' ELSE '// F$d' END
           || '~' || string_agg(replace(t.body, '$n', CAST(c.k AS VARCHAR)), '~' ORDER BY c.k)
           || '~' AS raw
  FROM (SELECT doc_id, source, coalesce(text, '') AS text, {ext_list}[doc_id % 5 + 1] AS ext FROM documents) d
  JOIN (SELECT doc_id, unnest(range(0, 2 + (doc_id // 5) % 6)) AS k FROM documents) c ON c.doc_id = d.doc_id
  JOIN (VALUES {values}) t(ext, idx, body)
    ON t.ext = d.ext AND t.idx = (d.doc_id * 31 + c.k * c.k * 17 + c.k) % (CASE d.ext {counts} END)
  GROUP BY d.doc_id, d.source, d.ext
) x
"""
