"""The registered queries once more as DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

from strandwise.functions.enums import ERROR_TYPES, KMER_TYPES


def _rc(x: str) -> str:
    return f"reverse(translate({x}, 'ACGTacgt', 'TGCAtgca'))"


def _changed(pos: str, swap: str, window: str = "win") -> str:
    return f"substr({window}, 1, {pos}) || translate(substr({window}, {pos} + 1, 1), 'ACGT', '{swap}') || substr({window}, {pos} + 2)"


READS = f"""
g AS (SELECT string_agg(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS s FROM part),
pl AS (
    SELECT o_orderkey AS rid, (o_orderkey * 7919) % (length(s) - 49) AS pos0, (o_orderkey % 2)::INT AS strand,
           CASE WHEN o_orderkey % 5 = 0 THEN ((o_orderkey * 31) % 50)::INT END AS err_pos
    FROM orders, g
),
w AS (SELECT pl.*, substr(s, (pos0 + 1)::BIGINT, 50) AS win FROM pl, g),
f AS (SELECT *, CASE WHEN err_pos IS NULL THEN win ELSE {_changed("err_pos", "CGTA")} END AS fwd FROM w),
reads AS (SELECT *, 'r' || rid::VARCHAR AS name, CASE WHEN strand = 1 THEN {_rc("fwd")} ELSE fwd END AS seq FROM f),
corrected AS (
    SELECT rid, name, seq AS original, CASE WHEN strand = 1 THEN {_rc("c")} ELSE c END AS seq FROM (
        SELECT *, CASE WHEN rid % 3 = 1 THEN win
                       WHEN rid % 3 = 2 THEN {_changed("((rid * 17) % 50)::INT", "CGTA")}
                       WHEN rid % 30 = 0 THEN substr(win, 1, err_pos) || translate(translate(substr(win, err_pos + 1, 1), 'ACGT', 'CGTA'), 'ACGT', 'GTAC') || substr(win, err_pos + 2)
                       ELSE fwd END AS c
        FROM reads)
),
truth AS (
    SELECT rid, (CASE WHEN strand = 1 THEN 49 - err_pos ELSE err_pos END)::INT AS pos,
           instr('ACGT', CASE WHEN strand = 1 THEN {_rc("substr(win, err_pos + 1, 1)")} ELSE substr(win, err_pos + 1, 1) END)::INT AS type,
           CASE WHEN strand = 1 THEN {_rc("substr(fwd, err_pos + 1, 1)")} ELSE substr(fwd, err_pos + 1, 1) END AS base_in_read
    FROM reads WHERE err_pos IS NOT NULL
),
pred AS (
    SELECT rid, p::INT AS pos, instr('ACGT', substr(seq, p + 1, 1))::INT AS type
    FROM (SELECT *, unnest(range(0, 50))::INT AS p FROM corrected WHERE seq <> original)
    WHERE substr(seq, p + 1, 1) <> substr(original, p + 1, 1)
)
"""

#: The gapped read set: its operations with their begin in read (rat) and genome stretch (place), and the reads.
GAPPED = f"""
g AS (SELECT string_agg(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS s FROM part),
cigars AS (SELECT kind, cigar FROM (VALUES (0, '50M'), (1, '20M1I29M'), (2, '20M1D30M'), (3, '5S45M'), (4, '10H40M'), (5, '25M3D25M'), (6, '15M2I33M'), (7, '2H3S20M1I10M2D12M3S4H')) t(kind, cigar)),
parsed AS (
    SELECT kind, i, regexp_extract(x, '[A-Z]') AS op, regexp_extract(x, '[0-9]+')::INT AS len
    FROM (SELECT kind, unnest(regexp_extract_all(cigar, '[0-9]+[A-Z]')) AS x, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[A-Z]'), 1) AS i FROM cigars)
),
ops AS (
    SELECT *, (sum(CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'I', 'S') THEN len ELSE 0 END)::INT AS rat,
           (sum(CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END) OVER w - CASE WHEN op IN ('M', 'D') THEN len ELSE 0 END)::INT AS place
    FROM parsed WINDOW w AS (PARTITION BY kind ORDER BY i)
),
gp AS (
    SELECT o_orderkey AS rid, (o_orderkey * 7919) % (length(s) - 59) AS pos0, ((o_orderkey % 2) * 16)::INT AS flag, ((o_orderkey // 2) % 8)::INT AS kind,
           ((o_orderkey * 31) % 40)::INT AS e, substr(s, ((o_orderkey * 7919) % (length(s) - 59) + 1)::BIGINT, 60) AS win
    FROM orders, g
),
gw AS (SELECT *, CASE WHEN rid % 5 = 0 THEN {_changed("e", "CGTA")} ELSE win END AS src FROM gp),
gapped AS (
    SELECT rid, any_value(pos0) AS pos0, any_value(flag) AS flag, kind, any_value(win) AS win,
           string_agg(CASE op WHEN 'M' THEN substr(src, place + 1, len) WHEN 'I' THEN translate(substr(src, place + 1, len), 'ACGT', 'TGCA')
                              WHEN 'S' THEN translate(substr(src, place + 1, len), 'ACGT', 'GTAC') ELSE '' END, '' ORDER BY i) AS seq
    FROM gw JOIN ops USING (kind) GROUP BY rid, kind
)
"""
GAPPED_ERRORS = f"""
spread AS (SELECT rid, flag, seq, win, length(seq)::INT AS n, op, len, rat, place, unnest(range(0, CASE WHEN op IN ('M', 'I') THEN len ELSE 1 END))::INT AS k FROM gapped JOIN ops USING (kind)),
raw AS (
    SELECT rid, flag, seq, n, rat + k AS p, 'sub' AS what, substr(win, place + k + 1, 1) AS b FROM spread WHERE op = 'M' AND substr(seq, rat + k + 1, 1) <> substr(win, place + k + 1, 1)
    UNION ALL SELECT rid, flag, seq, n, rat + k, 'ins', '' FROM spread WHERE op = 'I'
    UNION ALL SELECT rid, flag, seq, n, CASE WHEN flag = 16 THEN rat ELSE rat - 1 END, CASE WHEN len = 1 THEN 'del' ELSE 'multi' END, substr(win, place + 1, 1) FROM spread WHERE op = 'D'
    UNION ALL SELECT rid, flag, seq, n, greatest(rat - 1, 0), 'multi', '' FROM spread WHERE op = 'H'
),
gerrors AS (
    SELECT rid, (CASE WHEN flag = 16 THEN n - 1 - p ELSE p END)::INT AS pos,
           (CASE what WHEN 'sub' THEN instr('ACGT', CASE WHEN flag = 16 THEN {_rc("b")} ELSE b END) WHEN 'ins' THEN 5 WHEN 'multi' THEN 10
                      ELSE 5 + instr('ACGT', CASE WHEN flag = 16 THEN {_rc("b")} ELSE b END) END)::INT AS type,
           CASE WHEN flag = 16 THEN {_rc("substr(seq, p + 1, 1)")} ELSE substr(seq, p + 1, 1) END AS base_in_read
    FROM raw
)
"""

#: All-prefix edit costs row by row, then the way back from the end: equal or exchanged bases first, then missing, then surplus ones.
ALIGNED = """
pairs AS (
    SELECT rid, original AS a, CASE WHEN rid % 4 = 0 THEN substr(seq, 1, 20) || substr(seq, 22) WHEN rid % 4 = 1 THEN substr(seq, 1, 30) || 'ACG' || substr(seq, 31)
                                    WHEN rid % 16 = 2 THEN substr(seq, 6, 20) || substr(seq, 20, 31) ELSE seq END AS b
    FROM corrected
),
apart AS MATERIALIZED (SELECT rid, a, b, length(a)::INT AS n, length(b)::INT AS m FROM pairs WHERE a <> b),
dp AS (
    SELECT rid, 0 AS i, list_transform(range(0, m + 1), lambda x: x::INT) AS cost FROM apart
    UNION ALL
    SELECT rid, i + 1, list_transform(range(0, m + 1), lambda j: list_min(c[1 : j + 1]) + j::INT)
    FROM (
        SELECT rid, i, m, list_transform(range(0, m + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(cost[j] + (substr(a, i + 1, 1) <> substr(b, j, 1))::INT, cost[j + 1] + 1) END - j::INT) AS c
        FROM dp JOIN apart USING (rid) WHERE i < n
    )
),
mat AS MATERIALIZED (SELECT rid, a, b, n, m, list(cost ORDER BY i) AS t FROM dp JOIN apart USING (rid) GROUP BY ALL),
back AS (
    SELECT rid, n AS i, m AS j, NULL::INT AS pos, NULL::INT AS type FROM apart
    UNION ALL
    SELECT rid, CASE way WHEN 'del' THEN i ELSE i - 1 END, CASE way WHEN 'ins' THEN j ELSE j - 1 END,
           CASE way WHEN 'del' THEN i WHEN 'ins' THEN i - 1 ELSE CASE WHEN x <> y THEN i - 1 END END,
           CASE way WHEN 'del' THEN 5 + instr('ACGT', y)::INT WHEN 'ins' THEN 5 ELSE CASE WHEN x <> y THEN instr('ACGT', y)::INT END END
    FROM (
        SELECT back.rid, i, j, substr(a, i, 1) AS x, substr(b, j, 1) AS y,
               CASE WHEN i > 0 AND j > 0 AND t[i + 1][j + 1] = t[i][j] + (substr(a, i, 1) <> substr(b, j, 1))::INT THEN 'same'
                    WHEN j > 0 AND (i = 0 OR t[i + 1][j + 1] = t[i + 1][j] + 1) THEN 'del' ELSE 'ins' END AS way
        FROM back JOIN mat USING (rid) WHERE i > 0 OR j > 0
    )
),
ways AS (
    SELECT rid, pos, type FROM back WHERE type <= 5
    UNION ALL SELECT rid, pos, CASE WHEN count(*) > 1 THEN 10 ELSE min(type) END FROM back WHERE type > 5 GROUP BY rid, pos
)
SELECT rid, pos, type, substr(a, pos + 1, 1) AS base FROM ways JOIN apart USING (rid)
"""


def _model(ks: list[int], bias: bool = True) -> str:
    """counts (cnt), expectations (pusm), medians (med), biases (fill) and classes (cls) for some k."""
    filled = """
        SELECT k, gc, CASE WHEN bias <> 0 THEN bias
                           WHEN l IS NULL AND r IS NULL THEN 1.0
                           WHEN l IS NULL THEN r.b WHEN r IS NULL THEN l.b
                           ELSE l.b + (r.b - l.b) / (r.i - l.i) * (gc - l.i) END AS bias
        FROM (SELECT *, last_value(CASE WHEN bias <> 0 THEN {'i': gc, 'b': bias} END IGNORE NULLS) OVER (PARTITION BY k ORDER BY gc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
                     first_value(CASE WHEN bias <> 0 THEN {'i': gc, 'b': bias} END IGNORE NULLS) OVER (PARTITION BY k ORDER BY gc ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r
              FROM med)
    """
    flat = "SELECT k, gc, 1.0::DOUBLE AS bias FROM med"
    return f"""
kk AS (SELECT unnest({ks})::INT AS k),
occ0 AS (SELECT k, rid, seq, unnest(range(0, length(seq) - k + 1))::INT AS i FROM reads, kk),
occ AS (SELECT k, rid, i, length(seq) AS len, substr(seq, i + 1, k) AS kmer, least(substr(seq, i + 1, k), {_rc("substr(seq, i + 1, k)")}) AS canon FROM occ0),
cnt AS (SELECT k, canon, count(*) AS cnt FROM occ GROUP BY ALL),
pusm AS (
    SELECT k, sum(n * p) AS e FROM (
        SELECT k, n, ((len - k)::DOUBLE * (gl - len) + 1) / ((gl - k + 1)::DOUBLE * (gl - len + 1)) AS p
        FROM kk, (SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY 1), (SELECT length(s) AS gl FROM g))
    GROUP BY k
),
seen AS (SELECT DISTINCT k, kmer, canon FROM occ WHERE i < len - k),
bias AS (
    SELECT k, (length(kmer) - length(replace(replace(kmer, 'G', ''), 'C', '')))::INT AS gc, CASE WHEN cnt >= 0.2 * e THEN cnt / e ELSE 0 END AS bias
    FROM seen JOIN cnt USING (k, canon) JOIN pusm USING (k)
),
med AS (
    SELECT b.k, b.gc, coalesce(m, 0) AS bias FROM (SELECT k, unnest(range(0, k + 1))::INT AS gc FROM kk) b
    LEFT JOIN (SELECT k, gc, median(bias) AS m FROM bias WHERE bias > 0 GROUP BY ALL) USING (k, gc)
),
fill AS ({filled if bias else flat}),
cls AS (
    SELECT k, canon, cnt, (CASE WHEN c <= 1 OR c < 0.5 * e THEN 0 WHEN c <= 1.5 * e THEN 1 ELSE 2 END)::INT AS class
    FROM (SELECT cnt.k, canon, cnt, e, cnt / fill.bias AS c FROM cnt JOIN pusm USING (k)
          JOIN fill ON fill.k = cnt.k AND fill.gc = length(canon) - length(replace(replace(canon, 'G', ''), 'C', '')))
)
"""


GENOME = f"""
gocc AS (SELECT substr(s, i + 1, 15) AS kmer, least(substr(s, i + 1, 15), {_rc("substr(s, i + 1, 15)")}) AS canon FROM (SELECT s, unnest(range(0, length(s) - 14)) AS i FROM g)),
gcnt AS (SELECT canon, count(*) AS n FROM gocc GROUP BY 1)
"""

# every odd k up to the read's length: what k may grow to
EXTENDED = f"""
{_model(list(range(15, 50, 2)))},
ext AS (
    SELECT rid, i AS pos, min(CASE WHEN class <> 2 THEN k * 10 + class END) AS best
    FROM occ JOIN cls USING (k, canon) WHERE i + 15 < len AND (k = 15 OR i + k < len) GROUP BY ALL
),
cover AS (
    SELECT rid, p::INT AS pos, count(*) AS cover FROM (SELECT rid, unnest(range(pos, pos + best // 10)) AS p FROM ext WHERE best % 10 = 0) GROUP BY ALL
)
"""

#: Trusted k-mers of all lengths that correction can ask for, and edits: type 1-4 exchanges, 5 takes out, 6-9 put in after the place.
_EDITED = "CASE WHEN t <= 4 THEN substr({x}, 1, i) || substr('ACGT', t, 1) || substr({x}, i + 2) WHEN t = 5 THEN substr({x}, 1, i) || substr({x}, i + 2) ELSE substr({x}, 1, i + 1) || substr('ACGT', t - 5, 1) || substr({x}, i + 2) END"
GOOD = f"""
{_model(list(range(14, 51)))},
good AS MATERIALIZED (SELECT canon, class FROM cls WHERE class > 0)
"""
ADAPTIVE = f"""
{GOOD},
st AS (
    SELECT rid, seq, 0 AS pos, 15 AS k FROM reads
    UNION ALL
    SELECT rid, CASE WHEN f IS NULL THEN seq ELSE {_EDITED.format(x="seq").replace("t <=", "f.t <=").replace("t =", "f.t =").replace("'ACGT', t", "'ACGT', f.t").replace(" i", " (pos + f.i)")} END,
           CASE WHEN class = 2 AND pos + k + 2 < length(seq) THEN pos WHEN class = 2 THEN 1000 ELSE pos + 2 END, CASE WHEN class = 2 AND pos + k + 2 < length(seq) THEN k + 2 ELSE 15 END
    FROM (
        SELECT st.rid, st.seq, st.pos, st.k, coalesce(good.class, 0) AS class, f
        FROM st LEFT JOIN good ON good.canon = least(substr(seq, pos + 1, k), {_rc("substr(seq, pos + 1, k)")})
        LEFT JOIN (
            SELECT e.rid, min({{'i': i, 't': t}}) AS f
            FROM (
                SELECT rid, i, t, {_EDITED.format(x="kmer")} AS x
                FROM (SELECT rid, seq, pos, substr(seq, pos + 1, k) AS kmer, unnest(range(0, k))::INT AS i FROM st WHERE pos + 15 < length(seq)
                      AND least(substr(seq, pos + 1, k), {_rc("substr(seq, pos + 1, k)")}) NOT IN (SELECT canon FROM good)), range(1, 10) types(t)
                WHERE CASE WHEN t <= 4 THEN substr('ACGT', t::INT, 1) <> substr(kmer, i + 1, 1) ELSE pos + i > 0 AND pos + i < length(seq) - 1 END
            ) e JOIN good ON good.canon = least(x, {_rc("x")}) GROUP BY e.rid
        ) fixes ON fixes.rid = st.rid
    ) WHERE pos + 15 < length(seq)
)
"""



def _untrusted_windows(src: str) -> str:
    """rid, t, i, kk of the windows (rid, t, s, i, k) that are untrusted once k has grown over repeats."""
    return f"""
        SELECT rid, t, i, best // 10 AS kk FROM (
            SELECT rid, t, i, min(kk * 10 + coalesce(class, 0)) FILTER (coalesce(class, 0) <> 2) AS best
            FROM (SELECT *, unnest(range(k, 51, 2))::INT AS kk FROM ({src})) LEFT JOIN good ON canon = least(substr(s, i + 1, kk), {_rc("substr(s, i + 1, kk)")})
            WHERE kk = k OR i + kk < length(s) GROUP BY rid, t, i
        ) WHERE best % 10 = 0"""


#: States of reads: pos is null where the most covered place is to be found, else an edit there is judged with k.
SIMPLE = f"""
{GOOD},
st AS (
    SELECT rid, seq, [seq] AS had, NULL::INT AS pos, 15 AS k, 0 AS step FROM reads
    UNION ALL
    SELECT * FROM (
        SELECT st.rid, seq, had, top.pos, 15 AS k, step + 1 AS step
        FROM st JOIN (
            SELECT rid, pos FROM (
                SELECT rid, p::INT AS pos, count(*) AS n
                FROM (SELECT rid, unnest(range(i, i + kk)) AS p FROM ({_untrusted_windows("SELECT rid, 0 AS t, seq AS s, unnest(range(0, length(seq) - 15))::INT AS i, 15 AS k FROM st WHERE pos IS NULL")}))
                GROUP BY ALL
            ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, pos) = 1
        ) top ON top.rid = st.rid WHERE st.pos IS NULL
        UNION ALL
        SELECT rid, CASE WHEN tied THEN seq ELSE text END, CASE WHEN tied THEN had ELSE list_append(had, text) END, CASE WHEN tied THEN pos END, CASE WHEN tied THEN k + 2 ELSE 15 END, step + 1
        FROM (
            SELECT rid, any_value(seq) AS seq, any_value(had) AS had, any_value(pos) AS pos, any_value(k) AS k, any_value(step) AS step, bool_or(t > 0 AND n < before AND n = least(before, low)) AS tied,
                   min(n) FILTER (t > 0) AS best, any_value(before) AS before, arg_min(text, t) FILTER (t > 0 AND n = 0) AS text
            FROM (
                SELECT *, first_value(n) OVER (PARTITION BY rid ORDER BY t) AS before, min(n) OVER (PARTITION BY rid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low
                FROM (
                    SELECT e.rid, e.seq, e.had, e.pos, e.k, e.step, e.t, e.text, count(u.i) AS n
                    FROM ({{edits}}) e LEFT JOIN ({_untrusted_windows("SELECT rid, t, text AS s, unnest(range(greatest(0, pos - k + 1), least(least(length(seq) - 1, pos + k - 1), length(text)) - k + 1))::INT AS i, k FROM ({edits})")}) u
                    ON u.rid = e.rid AND u.t = e.t GROUP BY ALL
                )
            ) GROUP BY rid
        ) WHERE best < before AND CASE WHEN tied THEN k + 2 < length(seq) ELSE best = 0 AND NOT list_contains(had, text) END
    )
)
"""
_TRIED = f"""SELECT *, {_EDITED.format(x="seq").replace(" i", " pos").replace("t - 5", "(t - 5)::INT")} AS text FROM st, range(1, 10) types(t) WHERE pos IS NOT NULL AND length(seq) > k
             AND CASE WHEN t <= 4 THEN substr('ACGT', t::INT, 1) <> substr(seq, pos + 1, 1) ELSE pos > 0 AND pos < length(seq) - 1 END
             UNION ALL SELECT *, 0, seq FROM st WHERE pos IS NOT NULL AND length(seq) > k"""
SIMPLE = SIMPLE.replace("{edits}", _TRIED)

KMER_ROWS = f"""
{_model([15])}, {GENOME},
rows AS (
    SELECT o.rid, (CASE WHEN n IS NULL THEN 0 WHEN n = 1 THEN 1 ELSE 2 END)::INT AS truth, class AS predicted
    FROM occ o JOIN cls c ON o.k = c.k AND o.canon = c.canon LEFT JOIN gcnt ON gcnt.canon = o.canon WHERE i < len - 15
),
kconf AS (
    SELECT 'kmer' AS kind, t::INT AS truth, p::INT AS predicted, coalesce(n, 0)::BIGINT AS n
    FROM range(0, 3) a(t), range(0, 3) b(p) LEFT JOIN (SELECT truth, predicted, count(*) AS n FROM rows GROUP BY ALL) x ON x.truth = t AND x.predicted = p
)
"""

MATCHED = """
matched AS (
    SELECT coalesce(t.rid, p.rid) AS rid, coalesce(t.pos, p.pos) AS pos, 'base' AS kind, coalesce(t.type, 0)::INT AS truth, coalesce(p.type, 0)::INT AS predicted
    FROM truth t FULL JOIN pred p ON t.rid = p.rid AND t.pos = p.pos
),
econf AS (
    SELECT c.kind, t::INT AS truth, p::INT AS predicted,
           (coalesce(n, 0) + CASE WHEN t = p AND t = 0 THEN (SELECT sum(length(seq)) FROM reads) - (SELECT count(*) FROM matched)
                                  WHEN t = p AND t = 11 THEN (SELECT sum(length(seq)) FROM reads) ELSE 0 END)::BIGINT AS n
    FROM (SELECT CASE WHEN t < 6 THEN 'base' ELSE 'gap' END AS kind, t, p FROM range(0, 12) a(t), range(0, 12) b(p) WHERE (t < 6) = (p < 6)) c
    LEFT JOIN (SELECT kind, truth, predicted, count(*) AS n FROM matched GROUP BY ALL) m ON m.kind = c.kind AND m.truth = t AND m.predicted = p
)
"""


def _names(of: str) -> str:
    errors, classes = list(ERROR_TYPES), list(KMER_TYPES)
    name = lambda c: f"CASE WHEN kind = 'kmer' THEN {classes}[least({c}, 2) + 1] ELSE {errors}[{c} + 1] END AS {c}"
    return f"SELECT kind, {name('truth')}, {name('predicted')}, n FROM {of}"


def _metrics(of: str) -> str:
    return f"""
    SELECT kind, truth AS type, n AS tp, (c - n)::BIGINT AS fp, (a - c - r + n)::BIGINT AS tn, (r - n)::BIGINT AS fn, r::BIGINT AS true_total
    FROM (SELECT *, sum(n) OVER (PARTITION BY kind) AS a, sum(n) OVER (PARTITION BY kind, truth) AS r, sum(n) OVER (PARTITION BY kind, predicted) AS c FROM {of}) WHERE truth = predicted
    """


_RATIOS = {
    "accuracy": "(tp + fp) / nullif(tp + 2 * fp + fn, 0)::DOUBLE",
    "precision": "tp / nullif(tp + fp, 0)::DOUBLE",
    "recall": "tp / nullif(tp + fn, 0)::DOUBLE",
    "gain": "(tp - fp) / nullif(tp + fn, 0)::DOUBLE",
    "specificity": "tn / nullif(tn + fn, 0)::DOUBLE",
}
_F1 = "2 * (tp / nullif(tp + fp, 0)::DOUBLE) * (tp / nullif(tp + fn, 0)::DOUBLE) / nullif(tp / nullif(tp + fp, 0)::DOUBLE + tp / nullif(tp + fn, 0)::DOUBLE, 0)"


def _ratios(digits: int = 9) -> str:
    return ", ".join(f"round({x}, {digits}) AS {n}" for n, x in (_RATIOS | {"f1": _F1}).items())


def _information(of: str) -> str:
    return f"""
    SELECT kind, ht AS entropy_truth, hp AS entropy_predicted, coalesce(mi, 0) AS mutual_information, coalesce(mi, 0) / nullif(greatest(ht, hp), 0) AS nmi
    FROM (SELECT kind, coalesce(-sum(p * log2(p)), 0) AS ht FROM (SELECT kind, n / sum(n) OVER (PARTITION BY kind) AS p FROM (SELECT kind, truth, sum(n) AS n FROM {of} GROUP BY ALL)) WHERE p > 0 GROUP BY 1)
    JOIN (SELECT kind, coalesce(-sum(p * log2(p)), 0) AS hp FROM (SELECT kind, n / sum(n) OVER (PARTITION BY kind) AS p FROM (SELECT kind, predicted, sum(n) AS n FROM {of} GROUP BY ALL)) WHERE p > 0 GROUP BY 1) USING (kind)
    LEFT JOIN (SELECT kind, sum(n / a * log2(n * a / (r * c))) AS mi FROM (
        SELECT kind, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY kind))::DOUBLE AS a, (sum(n) OVER (PARTITION BY kind, truth))::DOUBLE AS r, (sum(n) OVER (PARTITION BY kind, predicted))::DOUBLE AS c FROM {of}) WHERE n > 0 GROUP BY 1) USING (kind)
    """


def _totals(of: str) -> str:
    none = "CASE kind WHEN 'base' THEN 0 ELSE 11 END"
    s = lambda cond: f"coalesce(sum(n) FILTER ({cond}), 0)::BIGINT"
    return f"""
    SELECT kind, sum(n)::BIGINT AS total, {s(f"truth <> {none} AND predicted <> {none} AND truth <> predicted")} AS confused, {s(f"truth = {none} AND predicted <> {none}")} AS introduced,
           {s(f"predicted <> {none}")} AS claimed, {s(f"truth <> {none} AND truth = predicted")} AS discovered, {s(f"truth <> {none} AND predicted = {none}")} AS undiscovered
    FROM {of} GROUP BY kind
    """


def _edited(after: bool) -> str:
    here, put = "substr(kmer, pos + 1, 1)", "CASE WHEN type = 10 THEN '_' ELSE substr('ACGT', (type - 6 + 1)::INT, 1) END"
    grown = f"{here} || {put}" if after else f"{put} || {here}"
    last = "NULL" if after else f"substr(kmer, 1, pos) || {grown} || substr(kmer, pos + 2)"
    return f"""
    SELECT rid, type, CASE WHEN type BETWEEN 1 AND 4 THEN substr(kmer, 1, pos) || substr('ACGT', type, 1) || substr(kmer, pos + 2)
                           WHEN type = 5 THEN substr(kmer, 1, pos) || substr(kmer, pos + 2)
                           WHEN type = 10 THEN {last}
                           WHEN type BETWEEN 6 AND 9 THEN substr(kmer, 1, pos) || {grown} || substr(kmer, pos + 2)
                           ELSE kmer END AS after
    FROM cases
    """


CASES = "cases AS (SELECT rid, seq AS kmer, (rid % length(seq))::INT AS pos, unnest(range(0, 12))::INT AS type FROM reads)"
CIGARS = "cig AS (SELECT rid, (rid % 5 + 1)::VARCHAR || 'S' || (rid % 7 + 20)::VARCHAR || 'M' || (rid % 3 + 1)::VARCHAR || 'I10M' AS c FROM reads)"
MOTIFS = f"""
mc AS (
    SELECT substr(seq, b + 1, len) AS motif, (pos - b)::INT AS pos, type, count(*) AS num_errors
    FROM (SELECT rid, pos, type, len, unnest(range(greatest(0, pos - len + 1), least(pos, 50 - len) + 1))::INT AS b FROM truth, range(1, 7) l(len)) JOIN reads USING (rid)
    GROUP BY ALL
),
mo AS (
    SELECT motif, CASE WHEN length(motif) % 2 = 0 AND motif = {_rc("motif")} THEN count(*) // 2 ELSE count(*) END AS cnt
    FROM (SELECT substr(x, i + 1, len) AS motif FROM (SELECT x, len, unnest(range(0, 50 - len + 1)) AS i FROM (SELECT unnest([seq, {_rc("seq")}]) AS x FROM reads), range(1, 7) l(len))) GROUP BY motif
),
mz AS (
    SELECT motif, pos, type, num_errors, CASE WHEN v > 0 THEN (num_errors - e) / sqrt(v) END AS z FROM (
        SELECT *, e * (i - l) * (i - r) / (i * i) AS v FROM (
            SELECT *, l * r / i AS e FROM (
                SELECT m.*,
                       (CASE WHEN m.pos = length(m.motif) - 1 THEN coalesce(lo.cnt, 0) ELSE coalesce(lm.num_errors, 0) END)::DOUBLE AS l,
                       (CASE WHEN m.pos = 0 THEN coalesce(ro.cnt, 0) ELSE coalesce(rm.num_errors, 0) END)::DOUBLE AS r,
                       nullif(CASE WHEN m.pos = 0 OR m.pos = length(m.motif) - 1 THEN coalesce(io.cnt, 0) ELSE coalesce(im.num_errors, 0) END, 0)::DOUBLE AS i
                FROM (SELECT * FROM mc WHERE length(motif) >= 3) m
                LEFT JOIN mc lm ON lm.motif = substr(m.motif, 1, length(m.motif) - 1) AND lm.pos = m.pos AND lm.type = m.type
                LEFT JOIN mo lo ON lo.motif = substr(m.motif, 1, length(m.motif) - 1)
                LEFT JOIN mc rm ON rm.motif = substr(m.motif, 2) AND rm.pos = m.pos - 1 AND rm.type = m.type
                LEFT JOIN mo ro ON ro.motif = substr(m.motif, 2)
                LEFT JOIN mc im ON im.motif = substr(m.motif, 2, length(m.motif) - 2) AND im.pos = m.pos - 1 AND im.type = m.type
                LEFT JOIN mo io ON io.motif = substr(m.motif, 2, length(m.motif) - 2))))
)
"""
PROFILE = """
prof AS (
    SELECT t.type, t.correct, t.read, coalesce(n, 0)::BIGINT AS n FROM (
        SELECT instr('ACGT', c)::INT AS type, c AS correct, r AS read FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS c), (SELECT unnest(['A', 'C', 'G', 'T', 'N']) AS r)
        UNION ALL SELECT unnest(range(5, 11))::INT, NULL, NULL) t
    LEFT JOIN (SELECT type, base_in_read AS read, count(*) AS n FROM truth GROUP BY ALL) x ON x.type = t.type AND x.read IS NOT DISTINCT FROM t.read
    UNION ALL SELECT NULL, 'bases', NULL, sum(length(seq))::BIGINT FROM reads
    UNION ALL SELECT NULL, 'noncorrect', NULL, count(*) FILTER (type BETWEEN 1 AND 5) FROM truth
    UNION ALL SELECT NULL, 'deleted', NULL, count(*) FILTER (type BETWEEN 6 AND 10) FROM truth
),
one AS (SELECT max(n) FILTER (type IS NULL AND correct = 'bases')::DOUBLE AS b, max(n) FILTER (type IS NULL AND correct = 'noncorrect') AS x, max(n) FILTER (type IS NULL AND correct = 'deleted') AS d FROM prof)
"""
SAM = """
recs AS (
    SELECT rid, name AS qname, (strand * 16 + CASE WHEN rid % 7 = 0 THEN 4 ELSE 0 END)::INT AS flag, pos0, fwd FROM reads
),
n AS (SELECT *, CASE WHEN rid % 11 = 0 THEN 2 ELSE 1 END AS n FROM recs)
"""


def _sql(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _pusm(p: str) -> str:
    return _sql(
        READS,
        f"""SELECT k::INT AS k, round(sum(n * p), 9) AS expectation, round(sqrt(sum(n * p * (1 - p))), 9) AS stdev FROM (
            SELECT k, n, {p} AS p FROM (SELECT unnest([15, 17, 21, 31]) AS k), (SELECT length(seq) AS len, count(*) AS n FROM reads GROUP BY 1), (SELECT length(s) AS gl FROM g)) GROUP BY k""",
    )


def _from_reads(select: str) -> str:
    return _sql(READS, f"SELECT {select} FROM reads")


_BOTH = "allconf AS (SELECT * FROM econf UNION ALL SELECT * FROM kconf)"
_EDITS = f"""
{READS}, {_model([14, 15, 16], bias=False)},
bad AS (SELECT DISTINCT o.kmer FROM occ o JOIN cls USING (k, canon) WHERE k = 15 AND class = 0 AND o.i < len - 15),
places AS (SELECT kmer, i::INT AS i, t::INT AS type, substr(kmer, 1, i::INT) AS head, substr(kmer, i::INT + 1, 1) AS here, substr(kmer, i::INT + 2) AS rest FROM bad, range(0, 15) a(i), range(1, 10) b(t)),
ed AS (
    SELECT kmer, i, type, CASE WHEN type <= 4 THEN head || substr('ACGT', type, 1) || rest
                               WHEN type = 5 THEN head || rest
                               ELSE head || here || substr('ACGT', type - 5, 1) || rest END AS x
    FROM places WHERE (type <= 4 AND substr('ACGT', type, 1) <> here) OR (type >= 5 AND i BETWEEN 1 AND 13)
)
"""


def _windows(k: int, select: str) -> str:
    """``select`` over rid, pos and kmer of all windows of the reads."""
    return _sql(READS, f"SELECT {select} FROM (SELECT rid, pos::INT AS pos, substr(seq, pos::INT + 1, {k}) AS kmer FROM reads, range(0, {51 - k}) p(pos))")


ORACLE_SQL: dict[str, str] = {
    "revcomp": _from_reads(f"rid, {_rc('seq')} AS rc"),
    "revcomp_read": _from_reads(f"rid, name, {_rc('seq')} AS seq, reverse(lower(seq)) AS qual"),
    "gc_count": _from_reads("rid, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')))::INT AS gc"),
    "gc_content": _from_reads("rid, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq), 9) AS gc"),
    "self_revcomp": _windows(4, f"rid, pos, (kmer = {_rc('kmer')})::INT AS own"),
    "kmer_to_number": _windows(20, "rid, pos, list_sum(list_transform(range(0, 20), lambda i: (instr('ACGT', substr(kmer, (i + 1)::INT, 1)) - 1)::BIGINT << (2 * (19 - i))::INT))::BIGINT AS number"),
    "number_to_kmer": _from_reads("rid, array_to_string(list_transform(range(0, 10), lambda i: substr('ACGT', ((((rid * 7919) % 1048576) >> (2 * (9 - i))::INT) % 4 + 1)::INT, 1)), '') AS kmer"),
    "base_to_number": _windows(1, "rid, pos, (instr('ACGT', kmer) - 1)::INT AS number"),
    "kmer_after_error_before": _sql(f"{READS}, {CASES}", _edited(after=False)),
    "kmer_after_error_after": _sql(f"{READS}, {CASES}", _edited(after=True)),
    "cigar_parse": _sql(f"{READS}, {CIGARS}", r"SELECT rid, idx::INT AS idx, regexp_extract_all(c, '(\d+)([MIDNSHP=X])', 2)[idx + 1] AS op, regexp_extract_all(c, '(\d+)([MIDNSHP=X])', 1)[idx + 1]::INT AS len FROM cig, range(0, 4) i(idx)"),
    "cigar_string": _sql(f"{READS}, {CIGARS}", r"SELECT rid, regexp_replace(c, '(\d+)([MIDNSHP=X])', '\2:\1 ', 'g') AS ops FROM cig"),
    "soft_clip_mask": _from_reads("rid, repeat('S', (rid % 5 + 1)::INT) || substr(seq, (rid % 5 + 2)::INT) AS masked, 1::INT AS clipped"),
    "name_normalize": _from_reads("rid, name AS norm"),
    "natural_sort_key": _from_reads("rid, 'r|' || lpad(rid::VARCHAR, 20, '0') || '|.|' || lpad((rid % 100)::VARCHAR, 20, '0') || '|b' AS key"),
    "error_types": f"SELECT c::INT AS code, {list(ERROR_TYPES)}[c + 1] AS name, CASE WHEN c < 6 THEN 'base' ELSE 'gap' END AS kind, (c BETWEEN 1 AND 10)::INT AS is_error FROM range(0, 12) t(c)",
    "inferred_types": _windows(1, "rid, pos, instr('ACGT', kmer)::INT AS sub, (instr('ACGT', kmer) + 5)::INT AS del"),
    "skipped_types": _sql(f"{READS}, {CASES}", "SELECT rid, type, ((pos IN (0, length(kmer) - 1) AND type >= 5) OR type = 10 OR (type BETWEEN 1 AND 4 AND substr('ACGT', type, 1) = substr(kmer, pos + 1, 1)))::INT AS skipped FROM cases"),
    "read_lengths": _sql(READS, "SELECT length(seq)::INT AS len, count(*) AS n FROM reads GROUP BY 1"),
    "kmer_windows": _sql(READS, "SELECT rid, pos::INT AS pos, substr(seq, pos::INT + 1, 31) AS kmer FROM reads, range(0, 19) p(pos)"),
    "kmer_count_both_strands": _sql(READS, f"SELECT 15::INT AS k, least(x, {_rc('x')}) AS kmer, count(*) AS cnt FROM (SELECT substr(seq, i::INT + 1, 15) AS x FROM reads, range(0, 36) r(i)) GROUP BY ALL"),
    "kmer_count_strands": _sql(READS, f"SELECT substr(x, i::INT + 1, 15) AS kmer, count(*) AS cnt FROM (SELECT unnest([seq, {_rc('seq')}]) AS x FROM reads), range(0, 36) r(i) GROUP BY ALL"),
    "kmer_count_naive": _sql(
        READS, f"SELECT kmer, (CASE WHEN kmer = {_rc('kmer')} THEN count(*) // 2 ELSE count(*) END)::BIGINT AS cnt FROM (SELECT substr(x, i::INT + 1, 15) AS kmer FROM (SELECT unnest([seq, {_rc('seq')}]) AS x FROM reads), range(0, 35) r(i)) GROUP BY kmer"
    ),
    "kmer_inverted_index": _sql(
        READS,
        f"""SELECT kmer, rid // 4096 AS block, CASE WHEN max(bool_or(again)) OVER (PARTITION BY kmer) THEN '' ELSE string_agg(rid::VARCHAR, ',' ORDER BY rid) END AS read_ids
            FROM (SELECT rid, kmer, count(*) OVER (PARTITION BY rid, kmer) > 1 AS again FROM (SELECT rid, least(x, {_rc("x")}) AS kmer FROM (SELECT rid, substr(seq, i::INT + 1, 31) AS x FROM reads, range(0, 20) r(i)))) GROUP BY kmer, rid // 4096""",
    ),
    "kmer_lookup": _sql(
        f"{READS}, asked AS (SELECT rid, pos::INT AS pos, substr(seq, pos::INT + 1, 15) AS x FROM reads, range(0, 36) p(pos))",
        f"""SELECT rid, pos, {_rc("x")} AS kmer, cnt FROM asked JOIN (SELECT least(x, {_rc("x")}) AS c, count(*) AS cnt FROM asked GROUP BY 1) ON c = least(x, {_rc("x")})""",
    ),
    "kmer_distinct": _sql(READS, "SELECT count(DISTINCT substr(seq, i::INT + 1, 15)) AS n FROM reads, range(0, 35) r(i)"),
    "pusm_linear": _pusm("((len - k)::DOUBLE * (gl - len) + 1) / ((gl - k + 1)::DOUBLE * (gl - len + 1))"),
    "pusm_circular": _pusm("(len - k + 1) / gl::DOUBLE"),
    "bias_no_genome": _sql(f"{READS}, {_model([15])}", "SELECT gc AS gc_count, count(*) AS n, round(avg(bias), 6) AS bias FROM bias WHERE bias > 0 GROUP BY gc"),
    "bias_with_genome": _sql(
        f"{READS}, {_model([15])}, {GENOME}",
        "SELECT (length(canon) - length(replace(replace(canon, 'G', ''), 'C', '')))::INT AS gc_count, count(*) AS n, round(avg(cnt / n), 6) AS bias FROM gocc JOIN gcnt USING (canon) JOIN cnt USING (canon) GROUP BY 1",
    ),
    "bias_median": _sql(f"{READS}, {_model([15])}", "SELECT k, gc AS gc_count, round(gc / k, 9) AS gc, round(bias, 9) AS bias FROM med"),
    "bias_filled": _sql(f"{READS}, {_model([15, 17])}", "SELECT k, gc AS gc_count, round(gc / k, 9) AS gc, round(bias, 9) AS bias FROM fill"),
    "bias_interpolated": _sql(
        f"{READS}, {_model([15])}, x AS (SELECT rid, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) * 15 AS x FROM reads)",
        "SELECT rid, round(a.bias + (b.bias - a.bias) * (x - a.gc), 9) AS bias FROM x JOIN fill a ON a.gc = least(floor(x + 1e-11), 15) JOIN fill b ON b.gc = least(a.gc + 1, 15)",
    ),
    "kmer_class_reads": _sql(f"{READS}, {_model([15])}", "SELECT k, canon AS kmer, cnt, class FROM cls"),
    "kmer_class_genome": _sql(f"{READS}, {GENOME}", "SELECT canon AS kmer, n AS cnt, (CASE WHEN n = 1 THEN 1 ELSE 2 END)::INT AS class FROM gcnt"),
    "kmer_class_read_median": _sql(
        f"{READS}, {_model([15])}, m AS (SELECT rid, greatest(median(cnt), 3)::DOUBLE AS median FROM occ JOIN cnt USING (k, canon) WHERE i < len - 15 GROUP BY 1)",
        """SELECT rid, median, count(*) FILTER (c = 0) AS n0, count(*) FILTER (c = 1) AS n1, count(*) FILTER (c = 2) AS n2 FROM (
               SELECT rid, median, CASE WHEN cnt <= 1 OR cnt < 0.5 * median THEN 0 WHEN cnt <= 1.5 * median THEN 1 ELSE 2 END AS c FROM occ JOIN cnt USING (k, canon) JOIN m USING (rid) WHERE i < len - 15) GROUP BY ALL""",
    ),
    "affected_area": _from_reads("rid, greatest(0, (rid % 50) - 14)::INT AS first, least(49, (rid % 50) + 14)::INT AS last"),
    "untrusted_per_read": _sql(f"{READS}, {EXTENDED}", "SELECT rid, count(*) FILTER (best % 10 = 0) AS untrusted, (count(*) FILTER (best % 10 = 0) = 0)::INT AS perfect FROM ext GROUP BY rid"),
    "bad_kmer_coverage": _sql(f"{READS}, {EXTENDED}", "SELECT * FROM cover"),
    "top_error_position": _sql(f"{READS}, {EXTENDED}", "SELECT rid, pos, cover FROM cover QUALIFY row_number() OVER (PARTITION BY rid ORDER BY cover DESC, pos) = 1"),
    "smallest_nonrepetitive": _sql(f"{READS}, {EXTENDED}", "SELECT rid, count(*) AS starts, sum(best // 10)::BIGINT AS sum_k, count(*) FILTER (best IS NULL) AS without FROM ext GROUP BY rid"),
    "fix_candidates": _sql(_EDITS, f"SELECT kmer, i, type FROM ed JOIN cls ON cls.canon = least(x, {_rc('x')}) WHERE class <> 0 QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY i, type) = 1"),
    "correct_none": _from_reads("rid, seq"),
    "edit_distance": _sql(READS, "SELECT rid, levenshtein(original, seq)::INT AS distance FROM corrected"),
    "correct_adaptive_kmer": f"WITH RECURSIVE {READS}, {ADAPTIVE} SELECT rid, seq FROM st WHERE pos + 15 >= length(seq)",
    "correct_simple_kmer": f"WITH RECURSIVE {READS}, {SIMPLE} SELECT rid, arg_max(seq, step) AS seq FROM st GROUP BY rid",
    "align_pairs": f"WITH RECURSIVE {READS}, {ALIGNED}",
    "cigar_extract_errors": _sql(READS, "SELECT * FROM truth"),
    "cigar_gapped_errors": _sql(f"{GAPPED}, {GAPPED_ERRORS}", "SELECT * FROM gerrors"),
    "truth_errors_substitutions": _sql(READS, "SELECT * FROM truth"),
    "name_join": _sql(READS, "SELECT reads.name AS norm_name, strand * 16 AS flag, pos0, corrected.seq AS corrected FROM reads JOIN corrected USING (rid)"),
    "error_full_outer": _sql(f"{READS}, {MATCHED}", "SELECT * FROM matched"),
    "multidel_smoothing": _sql(
        f"{READS}, c AS (SELECT rid, (rid % 7)::INT AS pos, (rid % 4 + 6)::INT AS type FROM reads UNION ALL SELECT rid, (rid % 5)::INT, ((rid // 3) % 4 + 6)::INT FROM reads)",
        "SELECT rid, pos, (CASE WHEN count(*) > 1 THEN 10 ELSE min(type) END)::INT AS type FROM c GROUP BY rid, pos UNION ALL SELECT rid, (rid % 5)::INT, (rid % 5 + 1)::INT FROM reads",
    ),
    "confusion_base": _sql(f"{READS}, {MATCHED}", _names("econf") + " WHERE kind = 'base'"),
    "confusion_gap": _sql(f"{READS}, {MATCHED}", _names("econf") + " WHERE kind = 'gap'"),
    "confusion_kmer": _sql(f"{READS}, {KMER_ROWS}", _names("kconf")),
    "switch_types": _sql(
        f"{READS}, {MATCHED}, sw AS (SELECT kind, truth, CASE WHEN truth = 0 OR predicted NOT IN (0, truth) THEN predicted WHEN predicted = 0 THEN truth ELSE 0 END AS predicted, n FROM econf WHERE kind = 'base')", _names("sw")
    ),
    "metrics_kmer": _sql(f"{READS}, {KMER_ROWS}, m AS ({_metrics('kconf')})", f"SELECT *, {_ratios()} FROM m"),
    "metrics_error": _sql(f"{READS}, {MATCHED}, m AS ({_metrics('econf')})", f"SELECT *, {_ratios()} FROM m"),
    "entropy_mi_nmi": _sql(
        f"{READS}, {MATCHED}, {KMER_ROWS}, {_BOTH}, inf AS ({_information('allconf')})",
        "SELECT kind, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("entropy_truth", "entropy_predicted", "mutual_information", "nmi")) + " FROM inf",
    ),
    "avg_f1": _sql(f"{READS}, {MATCHED}, {KMER_ROWS}, {_BOTH}, m AS ({_metrics('allconf')})", f"SELECT kind, round(avg({_F1}), 9) AS f1 FROM m WHERE kind = 'kmer' OR type NOT IN (0, 11) GROUP BY kind"),
    "error_totals": _sql(f"{READS}, {MATCHED}", _totals("econf")),
    "confusion_margins": _sql(f"{READS}, {KMER_ROWS}", "SELECT kind, truth, predicted, sum(n)::BIGINT AS n FROM kconf GROUP BY kind, CUBE (truth, predicted)"),
    "evaluation_report": _sql(
        f"{READS}, {MATCHED}, {KMER_ROWS}, {_BOTH}, m0 AS ({_metrics('allconf')}), m AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in (_RATIOS | {'sensitivity': _RATIOS['recall'], 'f1': _F1}).items())} FROM m0), inf AS ({_information('allconf')}), t AS ({_totals('econf')})",
        "".join(
            [
                " UNION ALL ".join(f"SELECT kind, type, '{c}' AS metric, round({c}::DOUBLE, 8) AS value FROM m" for c in ("tp", "fp", "tn", "fn", "true_total", *_RATIOS, "sensitivity", "f1")),
                "".join(f" UNION ALL SELECT kind, NULL, '{c}', round({c}, 8) FROM inf" for c in ("entropy_truth", "entropy_predicted", "mutual_information", "nmi")),
                " UNION ALL SELECT kind, NULL, 'f1', round(avg(f1), 8) FROM m WHERE kind = 'kmer' OR type NOT IN (0, 11) GROUP BY kind",
                "".join(f" UNION ALL SELECT kind, NULL, '{c}', {c}::DOUBLE FROM t" for c in ("total", "confused", "introduced", "claimed", "discovered", "undiscovered")),
                "".join(f" UNION ALL SELECT kind, NULL, '{c}_of_claimed', round({c} / nullif(claimed, 0)::DOUBLE, 8) FROM t" for c in ("discovered", "introduced", "confused")),
            ]
        ),
    ),
    "kmer_eval_variants": _sql(
        f"""{READS}, {_model([15])}, {GENOME},
        o AS (SELECT occ.rid, cnt, fill.bias, (CASE WHEN n IS NULL THEN 0 WHEN n = 1 THEN 1 ELSE 2 END)::INT AS truth FROM occ JOIN cnt USING (k, canon)
              JOIN fill ON fill.k = occ.k AND fill.gc = length(canon) - length(replace(replace(canon, 'G', ''), 'C', '')) LEFT JOIN gcnt USING (canon) WHERE i < len - 15),
        x AS (SELECT rid, (length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / length(seq) * 15 AS x FROM reads),
        rg AS (SELECT rid, a.bias + (b.bias - a.bias) * (x - a.gc) AS bias FROM x JOIN fill a ON a.gc = least(floor(x + 1e-11), 15) JOIN fill b ON b.gc = least(a.gc + 1, 15)),
        rm AS (SELECT rid, round(avg(bias), 12) AS mean, greatest(median(cnt), 3) AS med FROM o GROUP BY rid),
        v AS (
            SELECT 'kmer' AS variant, truth, cnt / bias AS c, e FROM o, pusm
            UNION ALL SELECT 'read_mean', truth, cnt / mean, e FROM o JOIN rm USING (rid), pusm
            UNION ALL SELECT 'read_gc', truth, cnt / rg.bias, e FROM o JOIN rg USING (rid), pusm
            UNION ALL SELECT 'read_median', truth, cnt, med FROM o JOIN rm USING (rid)
        )""",
        "SELECT variant, truth, (CASE WHEN c <= 1 OR c < 0.5 * e THEN 0 WHEN c <= 1.5 * e THEN 1 ELSE 2 END)::INT AS predicted, count(*) AS n FROM v GROUP BY ALL",
    ),
    "evaluate_by_alignment": _sql(f"{READS}, {MATCHED}", _names("econf")),
    "reads_all_correct": _sql(f"{READS}, {KMER_ROWS}", "SELECT count(*) AS reads, count(*) FILTER (ok) AS all_correct FROM (SELECT rid, bool_and(truth = predicted) AS ok FROM rows GROUP BY rid)"),
    "overall_profile_counts": _sql(f"{READS}, {PROFILE}", "SELECT * FROM prof"),
    "overall_error_rates": _sql(f"{READS}, {PROFILE}", "SELECT round(x / b, 9) AS current_base, round(d / b, 9) AS next_gap FROM one"),
    "overall_profile_logprob": _sql(
        f"{READS}, {PROFILE}",
        """SELECT type, read, CASE WHEN n > 0 THEN round(ln(n / b), 9) END AS log_p FROM prof, one WHERE type IS NOT NULL
           UNION ALL SELECT 0, NULL, round(ln((b - x) / b), 9) FROM one UNION ALL SELECT 11, NULL, round(ln((b - d) / b), 9) FROM one""",
    ),
    "motif_index": _sql(
        f"{READS}, m AS (SELECT substr(seq, pos::INT + 1, l.n::INT) AS motif, count(*) AS n FROM reads, range(1, 7) l(n), range(0, 50) p(pos) WHERE pos + l.n <= length(seq) GROUP BY 1)",
        """SELECT ((5 ** length(motif) - 5) / 4 + list_sum(list_transform(range(0, length(motif)), lambda i: (instr('ACGTN', substr(motif, (i + 1)::INT, 1)) - 1) * 5 ** (length(motif) - 1 - i))))::BIGINT AS idx, motif, n FROM m""",
    ),
    "motif_counts": _sql(f"{READS}, {MOTIFS}", "SELECT * FROM mc"),
    "motif_zscores": _sql(f"{READS}, {MOTIFS}", "SELECT motif, pos, type, num_errors, round(z, 6) AS z FROM mz"),
    "motif_extreme_z": _sql(
        f"{READS}, {MOTIFS}",
        """SELECT rid, pos, type, round(CASE WHEN abs(lo) > abs(hi) THEN lo ELSE hi END, 6) AS z FROM (
               SELECT c.rid, c.at AS pos, mz.type, min(z) AS lo, max(z) AS hi FROM (
                   SELECT rid, pos AS at, substr(seq, b + 1, len) AS motif, (pos - b)::INT AS p FROM (
                       SELECT rid, pos, len, unnest(range(greatest(0, pos - len + 1), least(pos, 50 - len) + 1))::INT AS b FROM truth, range(3, 7) l(len)) JOIN reads USING (rid)) c
               JOIN mz ON mz.motif = c.motif AND mz.pos = c.p WHERE z IS NOT NULL GROUP BY ALL)""",
    ),
    "sam_group": _sql(
        f"{READS}, {SAM}",
        f"SELECT qname, CASE WHEN flag & 16 <> 0 THEN {_rc('fwd')} ELSE fwd END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(lower(fwd)) ELSE lower(fwd) END AS qual, pos0 AS begin_pos, pos0 + 49 AS end_pos, n::INT AS n FROM n",
    ),
    "bam_totals": _sql(f"{READS}, {SAM}", "SELECT count(*) AS total, count(*) FILTER (flag & 4 = 0) AS mapped, count(*) FILTER (n = 1) AS unique FROM n"),
    "reads_written_and_read": _sql(READS, "SELECT row_number() OVER (ORDER BY rid) - 1 AS read_id, name, seq, translate(seq, 'ACGT', '@>+I') AS qual FROM reads"),
    "genome_written_and_read": _sql(READS, "SELECT i AS idx, substr(s, (i * 50 + 1)::BIGINT, 50) AS bases FROM (SELECT s, unnest(range(0, (length(s) + 49) // 50)) AS i FROM g)"),
    "bias_median_shifted": _sql(
        f"{READS}, {_model([15])}",
        """SELECT 15 AS k, b AS gc_count, round(b / 15.0::DOUBLE, 9) AS gc,
                  round(coalesce(CASE WHEN len(v) % 2 = 1 THEN v[least(len(v) // 2 + 2, len(v))] ELSE (v[len(v) // 2 + 1] + v[least(len(v) // 2 + 2, len(v))]) / 2 END, 0), 9) AS bias
           FROM (SELECT unnest(range(0, 16))::INT AS b) LEFT JOIN (SELECT gc, list_sort(list(bias)) AS v FROM bias WHERE bias > 0 GROUP BY gc) ON gc = b""",
    ),
    "bias_all_kmers": _sql(
        f"{READS}, {_model([8])}",
        f"""SELECT gc_count, count(*) AS n, round(avg(bias), 6) AS bias FROM (
                SELECT (length(x) - length(replace(replace(x, 'G', ''), 'C', '')))::INT AS gc_count, CASE WHEN cnt >= 0.2 * e THEN cnt / e ELSE 0 END AS bias
                FROM (SELECT array_to_string(list_transform(range(0, 8), lambda j: substr('ACGT', ((i // (4 ** j)::BIGINT) % 4 + 1)::BIGINT, 1)), '') AS x FROM range(0, 65536) t(i))
                JOIN cnt ON canon = least(x, {_rc("x")}) CROSS JOIN pusm
            ) WHERE bias > 0 GROUP BY gc_count""",
    ),
    "bam_records": _sql(GAPPED, "SELECT 'g' || rid::VARCHAR AS qname, flag, 'genome' AS rname, pos0, cigar, seq, translate(seq, 'ACGT', '5:?I') AS qual FROM gapped JOIN cigars USING (kind)"),
    "fasta_records": _from_reads(r"CASE WHEN rid % 2 = 0 THEN '@' || name || chr(10) || seq || chr(10) || '+' || chr(10) || lower(seq) ELSE '>' || name || chr(10) || seq END AS value"),
}
