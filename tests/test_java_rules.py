"""Java rules on programs written from the rule descriptions, several shapes per rule."""
import pytest
from file_tables import SF01, files_df

from revspark.operators import java_rules as J

METERS = """package plant;
import java.io.*;
public class Meters {
    byte[] header(File f, boolean trial) throws IOException {
        RandomAccessFile raf = new RandomAccessFile(f, "r");
        FileReader r = new FileReader(f);
        int b = r.read();
        return new byte[] {(byte) b};
    }
    void maybe(Socket socket, boolean ok) throws IOException {
        BufferedWriter out = new BufferedWriter(null);
        if (ok) {
            out.close();
        }
    }
    void both(boolean ok) throws IOException {
        BufferedWriter log = new BufferedWriter(null);
        log.write("x");
        log.close();
    }
    void last(boolean ok) throws IOException {
        FileChannel channel = open();
        try {
            channel.force(ok);
        } finally {
            if (channel.isOpen()) channel.close();
        }
    }
    InputStream hand() throws IOException {
        InputStream given = new FileInputStream("tank.bin");
        return wrap(given);
    }
    int scoped() throws IOException {
        try (Reader a = new FileReader("a"); Reader c = new FileReader("c")) {
            return a.read() + c.read();
        }
    }
}
"""
ROUTES = """package plant;
public class Routes {
    int plain() {
        Integer gate = null;
        return gate.intValue();
    }
    int oneBranch(boolean wet) {
        String lane = null;
        if (wet) {
            lane = "left";
        }
        return lane.length();
    }
    int bothWays(boolean wet) {
        String lane = null;
        lane = "middle";
        return lane.length();
    }
    void fallsThrough() {
        String pier = null;
        if (pier == null) {
            warn();
        }
        warn(pier.trim());
    }
    void leaves() {
        String dock = null;
        if (dock == null) {
            warn();
            return;
        }
        warn(dock.trim());
    }
    void fills() {
        String quay = null;
        if (quay == null) quay = "main";
        warn(quay.trim());
    }
    void inside() {
        String buoy = null;
        if (buoy != null) warn(buoy.trim());
    }
}
"""
LEDGER = """package plant;
import java.util.*;
@Component
public class Ledger {
    private static final int SPAN = 60;
    private long window = 60 * UNIT, other;
    private Map<String, List<Long>> rows = new TreeMap<>();
    private final List<String> names = new ArrayList<>();
    private Set<String> open;
    boolean full(int n) {
        return n > other;
    }
    long span() {
        return UNIT + SPAN;
    }
    synchronized void tick() {
        other++;
    }
    void guarded() {
        synchronized (this) { other = 3; }
    }
    void claim(String who, List<Long> first) {
        if (rows.get(who) == null)
            for (Long one : first) {
                rows.put(who, first);
            }
    }
    Set<String> opened() {
        return open;
    }
}
"""
STOCK = """package plant;
import java.util.List;
public class Stock {
    private PartDao partDao;
    void shelves(int[] bins, boolean dry) {
        for (int k = 0; k < bins.length; k++)
            if (!dry) {
                partDao.findBin(bins[k]);
                partDao.updateBin(bins[k]);
            }
    }
    void pages(EntityManager entityManager, List<String> qs) {
        while (more())
            entityManager.queryOf(next()).getResultList();
    }
    void lookup(List<Long> keys) {
        keys.stream().filter(k -> k > 4).map(k -> partDao.getPart(k)).toList();
        partDao.findAll();
    }
    void twice() {
        do {
            partDao.selectNext();
        } while (more());
    }
}
"""
QUERIES = """package plant;
public class Queries {
    void run(java.sql.Connection c, java.sql.Statement st, String plot) throws Exception {
        st.executeUpdate("DELETE FROM plots WHERE code = " + plot);
        c.prepareStatement("SELECT name " + "FROM plots");
        st.execute(wrap("a" + plot));
        st.execute(plot);
    }
}
"""
KEYS = """package plant;
public class Keys {
    String apiToken = "t-0-9";
    void login(Object o) {
        final String dbPasswd = "swordfish";
        // String pwd = "not code";
        String note = "password = 'x'";
        String secret = lookup();
    }
}
"""
EDGES = """package plant;
import java.util.List;
public class Edges {
    void walk(List<Integer> stops, StringBuilder sb) {
        for (int k = 1; k <= stops.size(); k++) { visit(k); }
        for (int k = 0; k < sb.length(); k++) { visit(k); }
        for (int k = 0; k <= limit(); k++) { visit(k); }
        for (int k = 0, n = 9; k <= sb.length(); k += 2) visit(n);
        for (int k = 0; k <= stops.size() || late(); k++) { visit(k); }
    }
}
"""


@pytest.fixture(scope="module")
def jt(spark):
    src = {"Meters.java": METERS, "Routes.java": ROUTES, "Ledger.java": LEDGER, "Stock.java": STOCK, "Queries.java": QUERIES,
           "Keys.java": KEYS, "Edges.java": EDGES}
    return J.JavaTables(files_df(spark, src))


def collect(jt, fn):
    return sorted((r.file, r.line, r.message) for r in fn(jt).collect())


def line_of(program, text):
    return 1 + program[:program.index(text)].count("\n")


def test_resource_leak(jt):
    want = [line_of(METERS, "FileReader r ="), line_of(METERS, "BufferedWriter out")]
    out = collect(jt, J.resource_leaks)
    assert [(f, n) for f, n, _ in out] == [("Meters.java", n) for n in want]
    assert "'r'" in out[0][2] and "'out'" in out[1][2]


def test_null_deref(jt):
    out = collect(jt, J.null_derefs)
    assert [n for _, n, _ in out] == [line_of(ROUTES, "return gate."), line_of(ROUTES, "return lane."), line_of(ROUTES, "warn(pier.")]
    assert f"(assigned null at line {line_of(ROUTES, 'Integer gate')})" in out[0][2]


def test_fields_are_declared_names_only(jt):
    f = {(r.f_name, r.type_text) for r in jt.fields.filter("file = 'Ledger.java'").collect()}
    assert {n for n, _ in f} == {"SPAN", "window", "other", "rows", "names", "open"}
    assert ("rows", "Map<String,List<Long>>") in f


def test_concurrency(jt):
    shared = collect(jt, J.shared_field_access)
    assert [(n, m.split("'")[1]) for _, n, m in shared] == [
        (line_of(LEDGER, "return n > other"), "other"), (line_of(LEDGER, "if (rows.get"), "rows"), (line_of(LEDGER, "return open"), "open")]
    assert [n for _, n, _ in collect(jt, J.check_then_act)] == [line_of(LEDGER, "if (rows.get")]
    assert [n for _, n, _ in collect(jt, J.unsafe_publication)] == [line_of(LEDGER, "return open")]


def test_receivers_are_whole_chains(jt):
    got = {(r.name, r.receiver) for r in jt.calls.filter("file = 'Stock.java'").collect()}
    assert {("getResultList", "entityManager.queryOf(next())"), ("map", "keys.stream().filter(k->k>4)"), ("findAll", "partDao")} <= got


def test_n_plus_one_loop_then_stream(jt):
    loop = sorted((r.line, r.code_snippet) for r in J.query_in_loop(jt).collect())
    at = line_of(STOCK, "partDao.findBin")
    chain = line_of(STOCK, "entityManager.queryOf(")
    assert loop == [(at, "partDao.findBin(bins[k])"), (at + 1, "partDao.updateBin(bins[k])"),
                    (chain, "entityManager.queryOf(next())"), (chain, "entityManager.queryOf(next()).getResultList()"),
                    (line_of(STOCK, "partDao.selectNext"), "partDao.selectNext()")]
    assert [n for _, n, _ in collect(jt, J.query_in_stream)] == [line_of(STOCK, "keys.stream")]


def test_sql_concat_only_top_level_plus(jt):
    at = line_of(QUERIES, "st.executeUpdate")
    assert [(f, n) for f, n, _ in collect(jt, J.sql_concatenation)] == [("Queries.java", at), ("Queries.java", at + 1)]


def test_secrets_skip_comments_and_strings(jt):
    assert [n for _, n, _ in collect(jt, J.hardcoded_secrets)] == [line_of(KEYS, "apiToken"), line_of(KEYS, "dbPasswd")]


def test_loop_bound(jt):
    assert [n for _, n, _ in collect(jt, J.loop_bound)] == [line_of(EDGES, "int k = 1;"), line_of(EDGES, "int k = 0, n = 9")]


def test_one_line_with_very_many_tokens(spark):
    body = " ".join(f"void m{k}() {{ String s{k} = null; s{k}.trim(); }}" for k in range(60))
    jt = J.JavaTables(files_df(spark, {"One.java": f"class One {{ {body} }}"}))
    assert J.null_derefs(jt).count() == 60


def test_corpus_counts_match_generator(spark):
    """Counts on the whole derived corpus equal the template occurrences."""
    import duckdb
    from revspark.plans import registry as R
    from revspark.sources.code_files import template_counts

    docs = duckdb.connect().execute(f"select doc_id from '{SF01}/documents.parquet'").fetchall()
    n_java = template_counts()["java"]
    cnt, conc = [0] * n_java, [0] * n_java
    for (d,) in docs:
        if d % 5:
            continue
        for k in range(2 + (d // 5) % 6):
            i = (d * 31 + k * k * 17 + k) % n_java
            cnt[i] += 1
            conc[i] += d % 2 == 0
    exp = {"j1_resource_leak": sum(cnt[i] for i in (0, 16, 17, 28, 31)), "j2_null_deref": sum(cnt[i] for i in (3, 18, 19, 30, 34)),
           "j3a_shared_field": sum(conc[i] for i in (5, 6, 7, 8, 9, 10, 22, 23, 24)), "j3b_check_then_act": cnt[6],
           "j3c_unsafe_publication": cnt[7], "j4a_query_in_loop": cnt[8] + 2 * (cnt[10] + cnt[23] + cnt[24]),
           "j4b_query_in_stream": cnt[9], "j5_sql_concat": cnt[11], "j6_hardcoded_secret": cnt[13],
           "j7_loop_bound": cnt[14]}
    jt = R.java_tables(spark, SF01)
    for key, fn in J.JAVA_RULES.items():
        assert fn(jt).count() == exp[key], key
