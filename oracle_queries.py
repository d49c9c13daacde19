"""SQL twins of the registered queries, for the side-by-side check.

Written independently of the Spark operators: plain joins without buckets,
set logic without salts, and the text similarity as a recursive query.
"""

from __future__ import annotations

# The demonstration models, shared with the Spark queries.
FEATURES = (
    "vendor_same", "bank_same", "currency_same", "invoice_similarity", "digit_similarity",
    "amount_relative_similarity", "date_proximity", "po_same", "description_similarity",
)
MEAN = (0.53, 0.97, 1.0, 0.75, 0.68, 0.51, 0.44, 0.01, 0.34)
SCALE = (0.5, 0.16, 1.0, 0.08, 0.1, 0.3, 0.25, 0.1, 0.21)
COEFFICIENT = (0.42, 0.27, 0.0, -0.6, 2.4, 2.1, 1.06, 0.43, 2.97)
INTERCEPT = -8.5
STRICT_INTERCEPT = -12.5
THRESHOLD = 0.9
NATIVE_FEATURES = (
    "vendor_same", "bank_same", "amount_relative_similarity", "date_proximity", "po_same",
)
FLOORS = (0.05, 0.80, 1.01)
CLASS_WEIGHTS = (0.75, 1.5)
PEPPER = "demo-only-pepper"
# Fixed value: invoices that a request document holds about at most.
REQUEST_ROWS = 500


def _terms(names):
    table = dict(zip(FEATURES, zip(MEAN, SCALE, COEFFICIENT)))
    return [(name, *table[name]) for name in names]


def _margin(names, intercept):
    parts = [f"({n} - {m}::DOUBLE) / {s}::DOUBLE * {c}::DOUBLE" for n, m, s, c in _terms(names)]
    return f"{intercept}::DOUBLE + " + " + ".join(parts)


def _copied(column: str, changed: str) -> str:
    return f"CASE WHEN d THEN {changed} ELSE {column} END AS {column}"


BASE = """
base AS (
  SELECT ok, sk, 'F-' || printf('%08d', ok) AS invoice_id, 'G-' || printf('%08d', ok) AS group_id,
    'SUP-' || printf('%04d', sk) AS vendor_account_id,
    'INV-' || printf('%04d', sk) || '-' || printf('%08d', ok) AS invoice_number,
    o_orderdate::DATE AS invoice_date, round(o_totalprice * 100)::BIGINT AS cents,
    CASE sk % 3 WHEN 0 THEN 'TRY' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE WHEN ok % 5 = 0 THEN '' ELSE 'PO-' || printf('%05d', o_custkey % 900) END AS po_number,
    'BANK-' || CASE WHEN ok % 40 = 0 THEN printf('%d', sk + 10000)
                    ELSE printf('%04d', sk - sk % 6 + sk % 3) END AS bank_fingerprint,
    p_name AS description
  FROM (SELECT l_orderkey AS ok, k.s AS sk, k.p AS pk
        FROM (SELECT l_orderkey, min({'n': l_linenumber, 's': l_suppkey, 'p': l_partkey}) AS k
              FROM lineitem GROUP BY 1))
  JOIN orders ON o_orderkey = ok JOIN part ON p_partkey = pk)"""

RECURRING = """
seen AS (
  SELECT *, lag(invoice_date) OVER v AS pd, lag(cents) OVER v AS pc,
    lag(description) OVER v AS ps, lag(po_number) OVER v AS pp
  FROM base WINDOW v AS (PARTITION BY vendor_account_id ORDER BY invoice_date, invoice_id, cents, description, po_number)),
repeated AS (
  SELECT * REPLACE (
    CASE WHEN rep THEN pd + (21 + ok % 37)::INTEGER ELSE invoice_date END AS invoice_date,
    CASE WHEN rep THEN pc ELSE cents END AS cents,
    CASE WHEN rep THEN ps ELSE description END AS description,
    CASE WHEN rep AND ok % 15 < 10 THEN pp ELSE po_number END AS po_number)
  FROM (SELECT *, ok % 5 = 2 AND pd IS NOT NULL AS rep FROM seen))"""


def _ledger(source: str = "base", name: str = "ledger") -> str:
    return f"""
{name}_typed AS (
  SELECT *, d AS is_duplicate_record, ok // 24 AS t,
    CASE WHEN NOT d THEN 'original' ELSE CASE (ok // 6) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'format_shift'
      WHEN 2 THEN 'amount_shift' ELSE 'weak_resubmission' END END AS duplicate_type
  FROM {source} CROSS JOIN (VALUES (false), (true)) c(d) WHERE NOT d OR ok % 6 = 1),
{name} AS (
  SELECT invoice_id || CASE WHEN d THEN '-2' ELSE '' END AS invoice_id, group_id,
    vendor_account_id,
    CASE duplicate_type WHEN 'format_shift' THEN
           replace(invoice_number, '-', CASE t % 3 WHEN 0 THEN '/' WHEN 1 THEN '.' ELSE '_' END)
             || CASE WHEN (ok // 72) % 2 = 1 THEN 'B' ELSE '' END
         WHEN 'weak_resubmission' THEN 'BILL ' || reverse(printf('%08d', ok))
         ELSE invoice_number END AS invoice_number,
    CASE WHEN d THEN invoice_date + (3 + t % 17)::INTEGER ELSE invoice_date END AS invoice_date,
    CASE duplicate_type WHEN 'amount_shift' THEN cents + cents // (64 + t % 64)
      WHEN 'weak_resubmission' THEN cents - cents // (34 + t % 30)
      ELSE cents END / 100.0::DOUBLE AS amount,
    currency,
    CASE WHEN duplicate_type = 'weak_resubmission' THEN 'PO-V' || printf('%04d', sk)
         ELSE po_number END AS po_number,
    bank_fingerprint, description, is_duplicate_record, duplicate_type
  FROM {name}_typed)"""


LEDGER = BASE + "," + _ledger()


def _norm(text: str) -> str:
    return f"regexp_replace(upper({text}), '[^A-Z0-9]+', '', 'g')"


PREPARED = (
    LEDGER
    + f""",
prepared AS (
  SELECT *, {_norm("invoice_number")} AS number_norm, {_norm("description")} AS description_norm,
    regexp_replace({_norm("invoice_number")}, '[^0-9]', '', 'g') AS number_digits
  FROM ledger)"""
)

_SIDES = (
    "invoice_id", "group_id", "vendor_account_id", "bank_fingerprint", "invoice_date", "amount",
    "po_number", "number_norm", "number_digits", "description_norm", "is_duplicate_record",
    "duplicate_type",
)


def _blocked(rows: str = "prepared", extra: tuple[str, ...] = ()) -> str:
    def side(alias: str, prefix: str) -> str:
        return ", ".join(f"{alias}.{c} AS {prefix}_{c}" for c in _SIDES)

    more = "".join(f", l.{c}" for c in extra)
    same = "".join(f" AND l.{c} = r.{c}" for c in extra)
    band = (
        "l.currency = r.currency AND r.invoice_date - l.invoice_date BETWEEN 0 AND 60 "
        "AND (l.invoice_date < r.invoice_date OR l.invoice_id < r.invoice_id)" + same
    )
    select = f"SELECT {side('l', 'left')}, {side('r', 'right')}{more}"
    return f""",
blocked AS (
  {select}, 'vendor' AS block FROM {rows} l JOIN {rows} r
    ON l.vendor_account_id = r.vendor_account_id AND {band}
  UNION ALL
  {select}, 'bank' AS block FROM {rows} l JOIN {rows} r
    ON l.bank_fingerprint = r.bank_fingerprint AND l.vendor_account_id <> r.vendor_account_id
    AND {band}),
gapped AS (
  SELECT *, abs(left_amount - right_amount) / greatest(left_amount, right_amount, 0.01) AS gap,
    CASE WHEN left_group_id = right_group_id THEN 1 ELSE 0 END AS label,
    CASE WHEN right_is_duplicate_record THEN right_duplicate_type ELSE left_duplicate_type END
      AS pair_type
  FROM blocked)"""


PAIRS = PREPARED + _blocked()

# Similarity of distinct text pairs: keep cutting at the longest common block.
# The block is coded as size * 1000 - start, so one maximum finds the longest
# and, among those, the earliest in the left text.
_BEST = """list_max(flatten([[CASE WHEN contains(b, substr(a, i, k)) THEN k * 1000 - i END
    for k in range(1, length(a) - i + 2)] for i in range(1, length(a) + 1)]))"""



def _alike(name: str, wanted: str) -> str:
    """Table ``name`` of (a, b, ratio) for the text pairs (a, b) that ``wanted`` selects."""
    return f""",
{name}_wanted AS ({wanted}),
{name}_segment AS (
  SELECT a AS a0, b AS b0, a, b, {_BEST} AS best FROM {name}_wanted WHERE a <> b AND a <> '' AND b <> ''
  UNION ALL
  SELECT a0, b0, a, b, {_BEST} AS best FROM (
    SELECT a0, b0,
      CASE side WHEN 0 THEN substr(a, 1, i - 1) ELSE substr(a, i + size) END AS a,
      CASE side WHEN 0 THEN substr(b, 1, j - 1) ELSE substr(b, j + size) END AS b
    FROM (SELECT a0, b0, a, b, size, i, strpos(b, substr(a, i, size)) AS j
          FROM (SELECT a0, b0, a, b, (best + 999) // 1000 AS size,
                  ((best + 999) // 1000) * 1000 - best AS i
                FROM {name}_segment WHERE best IS NOT NULL))
    CROSS JOIN (VALUES (0), (1)) s(side)) WHERE a <> '' AND b <> ''),
{name} AS (
  SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE
    ELSE 2.0::DOUBLE * coalesce(matched, 0) / (length(a) + length(b)) END AS ratio
  FROM {name}_wanted LEFT JOIN (SELECT a0, b0, sum((best + 999) // 1000) AS matched
                         FROM {name}_segment GROUP BY 1, 2) ON a0 = a AND b0 = b)"""


SIMILARITY = _alike(
    "alike",
    """
  SELECT left_number_norm AS a, right_number_norm AS b FROM gapped
  UNION SELECT left_number_digits, right_number_digits FROM gapped
  UNION SELECT left_description_norm, right_description_norm FROM gapped""",
)

_NATIVE = """
    (left_vendor_account_id = right_vendor_account_id)::INT::DOUBLE AS vendor_same,
    (left_bank_fingerprint = right_bank_fingerprint)::INT::DOUBLE AS bank_same,
    1.0::DOUBLE AS currency_same,
    greatest(0.0::DOUBLE, 1.0 - gap) AS amount_relative_similarity,
    exp(-(right_invoice_date - left_invoice_date) / 30.0::DOUBLE) AS date_proximity,
    (left_po_number <> '' AND left_po_number = right_po_number)::INT::DOUBLE AS po_same,
    greatest(left_amount, 0.0::DOUBLE) AS exposure"""


def _features() -> str:
    return f""",
features AS (
  SELECT * FROM (
    SELECT gapped.*, {_NATIVE}, n.ratio AS invoice_similarity, d.ratio AS digit_similarity,
      t.ratio AS description_similarity
    FROM gapped
    JOIN alike n ON n.a = left_number_norm AND n.b = right_number_norm
    JOIN alike d ON d.a = left_number_digits AND d.b = right_number_digits
    JOIN alike t ON t.a = left_description_norm AND t.b = right_description_norm)
  WHERE gap <= 0.05 OR invoice_similarity >= 0.55)"""


FEATURE_ROWS = PAIRS + SIMILARITY + _features()

SCORED = (
    FEATURE_ROWS
    + f""",
scored AS (SELECT *, 1.0 / (1.0 + exp(-({_margin(FEATURES, INTERCEPT)}))) AS probability
  FROM features)"""
)

JUDGED = (
    SCORED.replace("scored AS (SELECT *,", "rated AS (SELECT *,")
    + f", scored AS (SELECT *, (probability >= {THRESHOLD})::INT AS prediction FROM rated)"
)

_EXACT = (
    "(left_vendor_account_id = right_vendor_account_id AND left_number_norm = right_number_norm "
    "AND 1.0 - gap >= 0.999999)"
)

_ACTIONS = {
    "HOLD": "Pause payment and request two-record verification.",
    "REVIEW": "Queue for accounts-payable analyst review before payment.",
    "PASS": "No candidate exceeded the review threshold; retain normal controls.",
}


def _policy(threshold: float) -> str:
    return (
        f"CASE WHEN {_EXACT} AND probability >= {threshold} THEN 'HOLD' "
        f"WHEN probability >= {threshold} THEN 'REVIEW' ELSE 'PASS' END"
    )


def _action(state: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{a}'" for s, a in _ACTIONS.items())
    return f"CASE {state} {cases} END"


def _evidence(rows: str, names) -> str:
    parts = " UNION ALL ".join(
        f"SELECT left_invoice_id, right_invoice_id, {i} AS position, '{n}' AS feature, "
        f"round_even({n}, 6) AS value, "
        f"round_even(({n} - {m}::DOUBLE) / {s}::DOUBLE * {c}::DOUBLE, 6) AS contribution "
        f"FROM {rows}"
        for i, (n, m, s, c) in enumerate(_terms(names))
    )
    return f"""SELECT left_invoice_id, right_invoice_id, rank, feature,
  value, contribution FROM (
    SELECT *, row_number() OVER (PARTITION BY left_invoice_id, right_invoice_id
      ORDER BY abs(contribution) DESC, position) AS rank FROM ({parts})) WHERE rank <= 4"""


SPLIT = """,
anchor AS (SELECT group_id, min(invoice_date) AS anchor FROM ledger GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY anchor, group_id) AS place,
  count(*) OVER () AS total FROM anchor),
assigned AS (SELECT group_id, anchor, CASE
    WHEN place <= floor(total * 0.70::DOUBLE) THEN 'train'
    WHEN place <= floor(total * 0.85::DOUBLE) THEN 'validation' ELSE 'test' END AS split
  FROM numbered)"""

GRID = """
grid AS (SELECT CASE WHEN i = 180 THEN 0.95::DOUBLE
  ELSE i * ((0.95::DOUBLE - 0.05::DOUBLE) / 180) + 0.05::DOUBLE END AS threshold
  FROM range(181) t(i)),
histogram AS (SELECT probability, sum(label) AS p, count(*) - sum(label) AS n
  FROM scored GROUP BY 1),
everyone AS (SELECT sum(p) AS positives FROM histogram),
swept AS (SELECT threshold, coalesce(sum(p), 0) AS tp, coalesce(sum(n), 0) AS fp
  FROM grid LEFT JOIN histogram ON probability >= threshold GROUP BY 1),
table_ AS (SELECT threshold, tp, fp, positives - tp AS fn,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
    CASE WHEN positives = 0 THEN 0 ELSE tp / positives END AS recall,
    CASE WHEN tp + fp + positives = 0 THEN 0 ELSE 2 * tp / (tp + fp + positives) END AS f1
  FROM swept, everyone)"""

_RANKED = """
counts AS (SELECT probability, sum(label) AS pos, count(*) - sum(label) AS neg
  FROM scored GROUP BY 1),
running AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg,
    sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM counts WINDOW w AS (ORDER BY probability DESC)),
ranked AS (SELECT
    round(sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(p), 6) AS average_precision,
    round(1 - sum(pos * (cum_neg - neg / 2)) / (max(p)::DOUBLE * max(n)), 6) AS roc_auc
  FROM running)"""

_CONFUSION = """
  SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn,
    count(*) FILTER (label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (label = 1 AND prediction = 0) AS fn,
    count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM scored"""

_RATES = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 9) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 9) AS f1"""

_PAIR_IDS = "left_invoice_id, right_invoice_id"

# Documents read as invoices, so that the row contract has something to reject.
PAPERS = """
papers AS (
  SELECT doc_id::VARCHAR AS invoice_id, source AS vendor_account_id, text AS invoice_number,
    DATE '2024-01-01' + (doc_id % 366)::INTEGER AS invoice_date,
    (n_chars / 8)::DOUBLE AS amount, upper(lang) || CASE WHEN doc_id % 2 = 0 THEN 'X' ELSE '' END
      AS currency, lang AS po_number, text AS bank_fingerprint, text AS description
  FROM documents),
trimmed AS (
  SELECT * REPLACE (
    regexp_replace(invoice_number, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g') AS invoice_number,
    regexp_replace(bank_fingerprint, '^[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g') AS bank_fingerprint)
  FROM papers),
coded AS (
  SELECT invoice_id, list_filter([
    CASE WHEN length(invoice_number) NOT BETWEEN 1 AND 80 THEN 'invoice_number_length' END,
    CASE WHEN length(bank_fingerprint) NOT BETWEEN 1 AND 80 THEN 'bank_fingerprint_length' END,
    CASE WHEN regexp_matches(bank_fingerprint, '[\\x00-\\x1f]')
      THEN 'bank_fingerprint_control_character' END,
    CASE WHEN amount <= 0 THEN 'amount_not_positive' END,
    CASE WHEN amount * 100 <> floor(amount * 100) THEN 'amount_decimals' END,
    CASE WHEN NOT regexp_full_match(currency, '[A-Z]{3}') THEN 'currency_form' END,
    CASE WHEN length(description) > 500 THEN 'description_length' END], lambda c: c IS NOT NULL)
    AS violations FROM trimmed)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


def _fold(text: str) -> str:
    return f"upper(strip_accents(replace({text}, 'ß', 'SS')))"


_ALL = "SELECT * FROM ledger"
_MATCH_COLUMNS = f"""{_PAIR_IDS},
  'ref_' || substr(sha256('{PEPPER}:' || left_vendor_account_id), 1, 12) AS vendor_ref,
  round_even(probability, 6) AS risk_score, {_policy(THRESHOLD)} AS state"""
_FEATURE_LIST = ", ".join(f"round({f}, 9) AS {f}" for f in FEATURES)


def _bound(a: str, b: str) -> str:
    """The similarity of two texts is at most that of the shorter one matched whole."""
    return (
        f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0::DOUBLE "
        f"ELSE 2.0::DOUBLE * least(length({a}), length({b})) / (length({a}) + length({b})) END)"
    )


def _likely_scored(pairs: str) -> str:
    """``scored`` for pairs that can reach the threshold, found in two steps.

    All features but the text similarities are known for every pair; first the
    similarities count as their bounds, then the description's exactly. Only
    pairs that are left need the similarity of numbers.
    """
    names = [n for n, *_ in _terms(FEATURES)]
    best = {
        # its weight is below zero, so 0 is best unless the texts are equal
        "invoice_similarity": "(left_number_norm = right_number_norm)::INT::DOUBLE",
        "digit_similarity": _bound("left_number_digits", "right_number_digits"),
    }
    text = {"description_similarity": _bound("left_description_norm", "right_description_norm")}

    def margin(known: dict[str, str]) -> str:
        parts = [f"({known.get(n, n)} - {m}::DOUBLE) / {s}::DOUBLE * {c}::DOUBLE" for n, m, s, c in _terms(names)]
        return f"{INTERCEPT}::DOUBLE + " + " + ".join(parts)

    cut = f"ln({THRESHOLD}::DOUBLE / (1 - {THRESHOLD}::DOUBLE)) - 1e-6"
    return (
        pairs
        + f""",
near AS (SELECT * FROM (SELECT *, {_NATIVE} FROM gapped) WHERE {margin(best | text)} >= {cut})"""
        + _alike("texts", "SELECT DISTINCT left_description_norm AS a, right_description_norm AS b FROM near")
        + f""",
nearer AS (
  SELECT * FROM (SELECT near.*, ratio AS description_similarity FROM near
    JOIN texts ON a = left_description_norm AND b = right_description_norm) WHERE {margin(best)} >= {cut})"""
        + _alike(
            "numbers",
            "SELECT left_number_norm AS a, right_number_norm AS b FROM nearer "
            "UNION SELECT left_number_digits, right_number_digits FROM nearer",
        )
        + f""",
features AS (
  SELECT * FROM (SELECT nearer.*, n.ratio AS invoice_similarity, d.ratio AS digit_similarity FROM nearer
    JOIN numbers n ON n.a = left_number_norm AND n.b = right_number_norm
    JOIN numbers d ON d.a = left_number_digits AND d.b = right_number_digits)
  WHERE gap <= 0.05 OR invoice_similarity >= 0.55),
scored AS (SELECT *, 1.0 / (1.0 + exp(-({_margin(FEATURES, INTERCEPT)}))) AS probability FROM features)"""
    )


def _match_rows(pairs: str) -> str:
    return _likely_scored(pairs) + f""",
matched AS (SELECT {_MATCH_COLUMNS} FROM scored WHERE probability >= {THRESHOLD}),
flagged AS (SELECT * FROM scored WHERE probability >= {THRESHOLD}),
explained AS ({_evidence("flagged", FEATURES)}),
matches AS (SELECT m.*, {_action("state")} AS action, evidence FROM matched m JOIN (
    SELECT {_PAIR_IDS}, string_agg(feature, ',' ORDER BY rank) AS evidence FROM explained
    GROUP BY 1, 2) USING ({_PAIR_IDS}))"""


_MATCHES = _with(_match_rows(PAIRS), "SELECT * FROM matches")
_RANKED_MATCHES = _with(
    _match_rows(PAIRS),
    f"SELECT *, row_number() OVER (ORDER BY risk_score DESC, {_PAIR_IDS}) AS place, true AS ranked "
    "FROM matches",
)


def _logistic_sums() -> str:
    """All sums of the weighted log loss at the fixed parameters, place by place."""
    x = [f"(({n} - {m}::DOUBLE) / {s}::DOUBLE)" for n, m, s, _ in _terms(FEATURES)] + ["1.0::DOUBLE"]
    size = len(x)
    w = f"(CASE label WHEN 1 THEN {CLASS_WEIGHTS[1]}::DOUBLE ELSE {CLASS_WEIGHTS[0]}::DOUBLE END)"
    p = "(1.0 / (1.0 + exp(-z)))"
    sums = [f"sum({w} * (ln(1.0 + exp(-abs(z))) + greatest(z, 0.0) - label * z))"]
    sums += [f"sum({w} * {a} * ({p} - label))" for a in x]
    sums += [f"sum({w} * {a} * {b} * {p} * (1.0 - {p}))" for a in x for b in x]
    assert len(sums) == 1 + size + size * size
    columns = ", ".join(f"{value} AS s{k}" for k, value in enumerate(sums))
    rows = " UNION ALL ".join(f"SELECT {k}::INT AS place, round(s{k}, 3) AS total FROM totals" for k in range(len(sums)))
    return _with(
        FEATURE_ROWS
        + f", margins AS (SELECT *, {_margin(FEATURES, INTERCEPT)} AS z FROM features), "
        + f"totals AS MATERIALIZED (SELECT {columns} FROM margins)",
        rows,
    )


def _listed_columns() -> str:
    """Columns by table, from the catalog of the views; the ledger's are those of the contract."""
    wanted = ", ".join(f"('{c}')" for c in (*_INVOICE, "group_id"))
    known = ", ".join(f"'{c}'" for c in _INVOICE)
    counts = " ".join(f"WHEN '{t}' THEN (SELECT count(*) FROM {t})" for t in ("orders", "documents", "events"))
    return f"""WITH {LEDGER.strip()}, wanted(name) AS (VALUES {wanted}),
have AS (
  SELECT table_name AS source, column_name AS name FROM duckdb_columns()
    WHERE table_name IN ('orders', 'documents', 'events')
  UNION ALL SELECT 'ledger', name FROM wanted
  UNION ALL SELECT 'ledger', unnest(['is_duplicate_record', 'duplicate_type'])),
sources AS (SELECT DISTINCT source FROM have)
SELECT source, CASE source {counts} ELSE (SELECT count(*) FROM ledger) END AS rows,
  coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM wanted w
    WHERE NOT EXISTS (FROM have h WHERE h.source = s.source AND h.name = w.name)), '') AS missing,
  coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM have h
    WHERE h.source = s.source AND name NOT IN ({known})), '') AS unknown
FROM sources s"""


# A vendor's quarter, cut into documents of bounded size by the order's number.
_REQUEST_PAIRS = (
    PREPARED
    + f""", quarters AS (
  SELECT *, date_trunc('quarter', invoice_date) AS quarter, substr(invoice_id, 3, 8)::BIGINT AS ok FROM prepared),
parted AS (
  SELECT *, vendor_account_id || '/' || (ok % ((count(*) OVER (PARTITION BY vendor_account_id, quarter) + {REQUEST_ROWS - 1})
    // {REQUEST_ROWS})) AS document FROM quarters)"""
    + _blocked("parted", ("quarter", "document"))
)
_REQUESTS = (
    _REQUEST_PAIRS
    + SIMILARITY
    + _features()
    + f""",
scored AS (SELECT *, 1.0 / (1.0 + exp(-({_margin(FEATURES, INTERCEPT)}))) AS probability FROM features),
sized AS (SELECT document, quarter, count(*) AS invoices FROM parted GROUP BY 1, 2),
counted AS (SELECT document, quarter, count(*) AS reviewed,
  count(*) FILTER (probability >= {THRESHOLD}) AS flagged FROM scored GROUP BY 1, 2),
judged AS (SELECT document, quarter, invoices, coalesce(reviewed, 0) AS reviewed_pairs, coalesce(flagged, 0) AS flagged_pairs
  FROM sized LEFT JOIN counted USING (document, quarter))"""
)

_INVOICE = (
    "invoice_id", "vendor_account_id", "invoice_number", "invoice_date", "amount", "currency",
    "po_number", "bank_fingerprint", "description",
)


def _recall(pairs: str) -> str:
    return f"""SELECT count(*)::BIGINT AS groups, coalesce(sum(pairs), 0)::BIGINT AS positive_pairs,
    round(CASE WHEN count(*) = 0 THEN 1 ELSE least(1, sum(pairs) / count(*)) END, 9)
      AS candidate_recall,
    round(CASE WHEN count(*) = 0 THEN 1 ELSE count(*) FILTER (pairs > 0) / count(*) END, 9)
      AS group_recall
  FROM (SELECT group_id, count(*) AS records FROM ledger GROUP BY 1 HAVING count(*) > 1) g
  LEFT JOIN (SELECT left_group_id, count(*) AS pairs FROM {pairs} WHERE label = 1 GROUP BY 1) f
    ON left_group_id = group_id"""


# The ledger as it arrives in four batches. Spark drops a row behind the watermark that the batch before began
# with, that is the newest day of the batches up to the last but one, less the lateness.
_ARRIVALS = (
    LEDGER
    + """,
numbers AS (SELECT *, substr(invoice_id, 3, 8)::BIGINT AS k FROM ledger),
arriving AS (
  SELECT *, k % 23 = 0 AS bad_currency, k % 29 = 0 AS bad_amount, CASE WHEN k % 17 = 0 THEN 2 ELSE 1 END AS copies,
    CASE WHEN k % 13 = 0 THEN 3 ELSE (invoice_date >= DATE '1997-01-01')::INT + (invoice_date >= DATE '1999-01-01')::INT
      + (invoice_date >= DATE '2000-07-01')::INT END AS batch FROM numbers),
judged AS (
  SELECT *, invoice_date <= watermark AS behind FROM (
    SELECT *, NOT bad_currency AND NOT bad_amount AS fine,
      coalesce((SELECT max(invoice_date) FROM arriving o WHERE o.batch < a.batch - 1
        AND NOT o.bad_currency AND NOT o.bad_amount), DATE '1900-01-01') - 30 AS watermark
    FROM arriving a))"""
)

ORACLES: dict[str, str] = {
    "ledger": _with(LEDGER, _ALL),
    "recurring_ledger": _with(BASE + "," + RECURRING + "," + _ledger("repeated"), _ALL),
    "csv_source": _with(LEDGER, _ALL.replace("*", "* EXCLUDE (is_duplicate_record, duplicate_type)")),
    "json_source": _with(
        LEDGER,
        "SELECT * EXCLUDE (is_duplicate_record, duplicate_type, group_id), "
        "invoice_id AS group_id FROM ledger",
    ),
    "injected_duplicates": _with(
        LEDGER,
        "SELECT duplicate_type, count(*) AS records, round(sum(amount), 2) AS amount "
        "FROM ledger WHERE is_duplicate_record GROUP BY 1",
    ),
    "invoice_contract_violations": _with(
        PAPERS, "SELECT invoice_id, array_to_string(violations, ',') AS violations FROM coded"
    ),
    "invoice_contract_accepted": _with(
        LEDGER,
        "SELECT * EXCLUDE (is_duplicate_record, duplicate_type) FROM ledger",
    ),
    "violation_counts": _with(
        PAPERS,
        "SELECT code, count(*) AS invoices FROM (SELECT unnest(violations) AS code FROM coded) "
        "GROUP BY 1",
    ),
    "quality_profile": _with(
        LEDGER,
        """SELECT count(*) AS rows, count(DISTINCT invoice_id) AS unique_invoice_ids,
  0::BIGINT AS null_cells, count(*) FILTER (amount <= 0) AS non_positive_amounts,
  min(invoice_date) AS date_min, max(invoice_date) AS date_max,
  (SELECT count(*) FROM (SELECT 1 FROM ledger GROUP BY group_id HAVING count(*) > 1))
    AS duplicate_groups FROM ledger""",
    ),
    "table_checks": """SELECT count(*) AS rows,
  count(*) FILTER (value <= 0 OR isnan(value)) AS bad_amounts,
  count(*) FILTER (event_id IS NULL OR user_id IS NULL OR event_type IS NULL OR ts IS NULL
    OR value IS NULL OR props IS NULL) AS rows_with_null,
  count(*) FILTER (TRY_CAST(CASE WHEN event_id % 7 = 0 THEN left(ts::VARCHAR, 10) || ' 25:61'
    WHEN event_id % 11 = 0 THEN left(ts::VARCHAR, 4) || '-02-30' ELSE ts::VARCHAR END AS TIMESTAMP) IS NULL) AS bad_dates
FROM events""",
    "duplicate_ids": "SELECT l_orderkey || '-' || l_linenumber AS invoice_id, count(*) AS copies "
    "FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "null_cells": "SELECT 2 * count(*) FILTER (l.doc_id IS NULL) AS null_cells "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "group_sizes": _with(
        LEDGER, "SELECT group_id, count(*) AS records FROM ledger GROUP BY 1"
    ),
    "ascii_upper": f"SELECT doc_id, {_fold('text')} AS folded FROM documents",
    "normalize_identifier": "SELECT doc_id, regexp_replace("
    f"{_fold('text')}, '[^A-Z0-9]+', '', 'g') AS normalized FROM documents",
    "normalize_invoice_number": _with(
        LEDGER, f"SELECT invoice_id, {_norm('invoice_number')} AS normalized FROM ledger"
    ),
    "digit_signature": "SELECT doc_id, regexp_replace(text, '\\P{Nd}+', '', 'g') AS digits "
    "FROM documents",
    "safe_reference": _with(
        LEDGER,
        f"SELECT invoice_id, 'ref_' || substr(sha256('{PEPPER}:' || vendor_account_id), 1, 12) "
        "AS vendor_ref FROM ledger",
    ),
    "vendor_pairs": _with(PAIRS, f"SELECT {_PAIR_IDS} FROM blocked WHERE block = 'vendor'"),
    "bank_only_pairs": _with(PAIRS, f"SELECT {_PAIR_IDS} FROM blocked WHERE block = 'bank'"),
    "blocked_pairs": _with(PAIRS, f"SELECT {_PAIR_IDS}, block, label FROM gapped"),
    "amount_gap_pairs": _with(
        PAIRS, f"SELECT {_PAIR_IDS}, round(gap, 9) AS gap, label FROM gapped WHERE gap <= 0.05"
    ),
    "candidate_pairs": _with(FEATURE_ROWS, f"SELECT {_PAIR_IDS}, label FROM features"),
    "pair_lookup": _with(
        FEATURE_ROWS,
        f"SELECT {_PAIR_IDS}, left_vendor_account_id, right_vendor_account_id, left_amount, "
        "right_amount FROM features",
    ),
    "candidate_recall": _with(FEATURE_ROWS, _recall("features")),
    "amount_gap_recall": _with(PAIRS, _recall("(SELECT * FROM gapped WHERE gap <= 0.05)")),
    "native_pair_features": _with(
        PAIRS + f", native AS (SELECT *, {_NATIVE} FROM gapped)",
        f"SELECT {_PAIR_IDS}, label, pair_type, exposure, "
        + ", ".join(f"round({f}, 9) AS {f}" for f in (*NATIVE_FEATURES, "currency_same"))
        + " FROM native",
    ),
    "similarity_features": _with(
        FEATURE_ROWS, f"SELECT {_PAIR_IDS}, label, pair_type, exposure, {_FEATURE_LIST} FROM features"
    ),
    "description_similarity": _with(
        FEATURE_ROWS,
        "SELECT left_description_norm, right_description_norm, count(*) AS pairs, "
        "round(max(description_similarity), 9) AS similarity FROM features GROUP BY 1, 2",
    ),
    "exact_baseline": _with(
        FEATURE_ROWS, f"SELECT {_PAIR_IDS}, {_EXACT}::INT AS prediction, label FROM features"
    ),
    "exact_key_hold": _with(
        PAIRS,
        f"SELECT {_PAIR_IDS}, 'ref_' || substr(sha256('{PEPPER}:' || left_vendor_account_id), "
        f"1, 12) AS vendor_ref, label FROM gapped WHERE {_EXACT}",
    ),
    "group_anchors": _with(LEDGER + SPLIT, "SELECT group_id, anchor FROM anchor"),
    "temporal_split": _with(
        LEDGER + SPLIT,
        "SELECT invoice_id, group_id, split FROM ledger JOIN assigned USING (group_id)",
    ),
    "split_counts": _with(
        LEDGER + SPLIT,
        "SELECT split, count(*) AS rows, count(*) FILTER (is_duplicate_record) AS "
        "duplicate_records FROM ledger JOIN assigned USING (group_id) GROUP BY 1",
    ),
    "split_overlap": _with(
        LEDGER + SPLIT,
        "SELECT group_id, min(split) AS first_split, max(split) AS last_split "
        "FROM ledger JOIN assigned USING (group_id) GROUP BY 1 "
        "HAVING count(DISTINCT split) > 1",
    ),
    "split_candidate_pairs": _with(
        PREPARED
        + SPLIT
        + ", parted AS (SELECT prepared.*, split FROM prepared JOIN assigned USING (group_id))"
        + _blocked("parted", ("split",))
        + SIMILARITY
        + _features(),
        "SELECT split, count(*) AS pairs, count(*) FILTER (label = 1) AS positive_pairs, "
        "count(*) FILTER (label = 0) AS negative_pairs FROM features GROUP BY 1",
    ),
    "stratified_sample": _with(
        LEDGER,
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY is_multi
    ORDER BY invoice_date, invoice_id) AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY group_id) > 1 AS is_multi FROM ledger))
WHERE position <= 60""",
    ),
    "ledger_order": _with(
        LEDGER,
        "SELECT *, row_number() OVER (ORDER BY invoice_date, invoice_id) AS place FROM ledger",
    ),
    "feature_statistics": _with(
        FEATURE_ROWS,
        " UNION ALL ".join(
            f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, "
            f"round(CASE WHEN min({f}) = max({f}) THEN 1 ELSE stddev_pop({f}) END, 6) AS scale "
            "FROM features"
            for f in FEATURES
        ),
    ),
    "class_weights": _with(
        FEATURE_ROWS,
        "SELECT label, count(*) AS pairs, "
        "round((SELECT count(*) FROM features) / (2 * count(*)), 9) AS weight "
        "FROM features GROUP BY 1",
    ),
    "predict_fixed_model": _with(
        SCORED, f"SELECT {_PAIR_IDS}, round(probability, 6) AS probability FROM scored"
    ),
    "feature_contributions": _with(SCORED, _evidence("scored", FEATURES)),
    "policy_decision": _with(
        SCORED,
        f"SELECT {_PAIR_IDS}, state, {_action('state')} AS action "
        f"FROM (SELECT *, {_policy(THRESHOLD)} AS state FROM scored)",
    ),
    "threshold_table": _with(
        JUDGED + "," + GRID,
        "SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, "
        "round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 "
        "FROM table_",
    ),
    "threshold_select": _with(
        JUDGED.replace(f"{INTERCEPT}::DOUBLE", f"{STRICT_INTERCEPT}::DOUBLE") + "," + GRID,
        "SELECT threshold FROM table_ WHERE precision >= 0.80 "
        "ORDER BY f1 DESC, precision DESC, threshold DESC LIMIT 1",
    ),
    "confusion_matrix": _with(
        JUDGED, f"SELECT tn, fp, fn, tp, {_RATES} FROM ({_CONFUSION})"
    ),
    "average_precision": _with(
        JUDGED + "," + _RANKED, "SELECT average_precision FROM ranked"
    ),
    "roc_auc": _with(JUDGED + "," + _RANKED, "SELECT roc_auc FROM ranked"),
    "evaluate_fixed_model": _with(
        JUDGED + "," + _RANKED,
        f"SELECT average_precision, roc_auc, tn, fp, fn, tp, {_RATES} "
        f"FROM ranked, ({_CONFUSION})",
    ),
    "evaluate_baseline": _with(
        FEATURE_ROWS
        + f", scored AS (SELECT *, {_EXACT}::INT AS prediction, {_EXACT}::INT::DOUBLE "
        "AS probability FROM features),"
        + _RANKED,
        f"SELECT average_precision, roc_auc, tn, fp, fn, tp, {_RATES} "
        f"FROM ranked, ({_CONFUSION})",
    ),
    "operational_metrics": _with(
        JUDGED,
        """SELECT round(avg(prediction), 9) AS review_rate,
  round(coalesce(sum(exposure) FILTER (label = 1 AND prediction = 1), 0)
    / sum(exposure) FILTER (label = 1), 9) AS duplicate_value_capture,
  round(coalesce(sum(exposure) FILTER (label = 1 AND prediction = 0), 0)
    + 50.0 * count(*) FILTER (label = 0 AND prediction = 1), 2) AS expected_control_cost
FROM scored""",
    ),
    "report_fixed_model": _with(
        PREPARED
        + SPLIT
        + ", parted AS (SELECT prepared.*, split FROM prepared JOIN assigned USING (group_id) WHERE split = 'test')"
        + _blocked("parted", ("split",))
        + SIMILARITY
        + _features()
        + f""",
rated AS (SELECT *, 1.0 / (1.0 + exp(-({_margin(FEATURES, INTERCEPT)}))) AS probability FROM features),
scored AS (
  SELECT 'model' AS judge, label, exposure, probability, (probability >= {THRESHOLD})::INT AS prediction FROM rated
  UNION ALL
  SELECT 'baseline', label, exposure, {_EXACT}::INT::DOUBLE, {_EXACT}::INT FROM rated),
counts AS (SELECT judge, probability, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY ALL),
running AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg
  FROM counts WINDOW w AS (PARTITION BY judge ORDER BY probability DESC)),
ranked AS (SELECT judge, round(sum(pos * (cum_pos / (cum_pos + cum_neg))) / sum(pos), 6) AS average_precision,
    round(1 - sum(pos * (cum_neg - neg / 2)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS roc_auc FROM running GROUP BY 1),
confused AS ({_CONFUSION.replace("SELECT count", "SELECT judge, count", 1)} GROUP BY judge),
costs AS (SELECT judge, round(avg(prediction), 9) AS review_rate,
    round(coalesce(sum(exposure) FILTER (label = 1 AND prediction = 1), 0)
      / sum(exposure) FILTER (label = 1), 9) AS duplicate_value_capture,
    round(coalesce(sum(exposure) FILTER (label = 1 AND prediction = 0), 0)
      + 50.0 * count(*) FILTER (label = 0 AND prediction = 1), 2) AS expected_control_cost
  FROM scored GROUP BY 1)""",
        f"SELECT judge, average_precision, roc_auc, tn, fp, fn, tp, {_RATES}, review_rate, duplicate_value_capture, "
        "expected_control_cost FROM ranked JOIN confused USING (judge) JOIN costs USING (judge)",
    ),
    "recall_by_type": _with(
        JUDGED,
        "SELECT pair_type AS duplicate_type, round(avg(prediction), 9) AS recall, "
        "count(*) AS support FROM scored WHERE label = 1 GROUP BY 1",
    ),
    "run_compare": _with(
        BASE + "," + RECURRING + "," + _ledger() + "," + _ledger("repeated", "other"),
        " UNION ALL ".join(
            f"SELECT invoice_id, '{c}' AS \"column\" FROM ledger l JOIN other o USING (invoice_id) "
            f"WHERE {unequal}"
            for c, unequal in (
                ("invoice_date", "l.invoice_date <> o.invoice_date"),
                ("amount", "abs(l.amount - o.amount) > 1e-12 + 1e-9 * abs(o.amount)"),
                ("po_number", "l.po_number <> o.po_number"),
                ("description", "l.description <> o.description"),
            )
        ),
    ),
    "unequal_rows": _with(
        BASE + "," + RECURRING + "," + _ledger() + "," + _ledger("repeated", "other"),
        """SELECT side, count(*) AS records FROM (
  (SELECT 'reference' AS side, * FROM (SELECT * FROM ledger EXCEPT ALL SELECT * FROM other))
  UNION ALL
  (SELECT 'candidate' AS side, * FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM ledger)))
GROUP BY 1""",
    ),
    "triage_fixed_model": _RANKED_MATCHES,
    "triage_stream": _MATCHES,
    "stream_late_rows": _with(
        _ARRIVALS,
        """SELECT batch::BIGINT AS batch, sum(copies)::BIGINT AS rows_read, count(*) FILTER (fine AND NOT behind) AS accepted,
  coalesce(sum(copies) FILTER (fine AND behind), 0)::BIGINT AS late,
  coalesce(sum(copies - 1) FILTER (fine AND NOT behind), 0)::BIGINT AS repeated
FROM judged GROUP BY 1""",
    ),
    "stream_quarantine": _with(
        _ARRIVALS,
        """SELECT invoice_id, concat_ws(',', CASE WHEN bad_amount THEN 'amount_not_positive' END,
    CASE WHEN bad_currency THEN 'currency_form' END) AS reasons, 1::BIGINT AS copies
  FROM judged CROSS JOIN range(2) t(copy) WHERE NOT fine AND copy < copies
UNION ALL
SELECT invoice_id, 'invoice_id_repeated', copies::BIGINT FROM judged
  WHERE fine AND copies > 1 AND invoice_date + 30 > watermark
    AND invoice_date + 30 <= (SELECT max(invoice_date) FROM judged WHERE fine) - 30""",
    ),
    "match_sink": _MATCHES,
    "request_matches": _with(_match_rows(_REQUEST_PAIRS), "SELECT * FROM matches"),
    "request_summary": _with(
        _REQUESTS,
        "SELECT invoices, reviewed_pairs, flagged_pairs, count(*) AS documents FROM judged GROUP BY 1, 2, 3",
    ),
    "request_documents": _with(
        _REQUESTS
        + """,
kinds AS (SELECT *, (substr(document, 5, 4)::BIGINT + year(quarter) * 4 + quarter(quarter)) % 8 AS kind FROM judged),
told AS (
  SELECT CASE WHEN kind IN (0, 2, 3, 4, 5) THEN 'refused' ELSE 'accepted' END AS outcome,
    CASE kind WHEN 0 THEN 'document_unreadable' WHEN 2 THEN 'document_unreadable' WHEN 3 THEN 'unknown_document_field'
      WHEN 4 THEN 'no_invoices' WHEN 5 THEN 'invoice_id_repeated' ELSE '' END AS reasons,
    CASE WHEN kind IN (0, 2, 3, 4) THEN 0 WHEN kind = 5 THEN invoices + 1 ELSE invoices END AS invoices,
    CASE WHEN kind IN (0, 2, 3, 4, 5) THEN 0 ELSE reviewed_pairs END AS reviewed_pairs,
    CASE WHEN kind IN (0, 2, 3, 4, 5) THEN 0 ELSE flagged_pairs END AS flagged_pairs,
    CASE kind WHEN 1 THEN 2 ELSE 1 END AS documents FROM kinds)""",
        "SELECT outcome, reasons, invoices, reviewed_pairs, flagged_pairs, sum(documents)::BIGINT AS documents "
        "FROM told GROUP BY ALL",
    ),
    "csv_quarantine": _with(
        LEDGER,
        f"""SELECT row_text || CASE ok % 10 WHEN 7 THEN ',more' ELSE '' END AS row_text,
  CASE ok % 10 WHEN 7 THEN 10 ELSE 8 END AS fields, 9 AS expected,
  CASE ok % 10 WHEN 7 THEN 'too_many_fields' ELSE 'too_few_fields' END AS reason
FROM (SELECT substr(invoice_id, 3, 8)::BIGINT AS ok, concat_ws(',', invoice_id, vendor_account_id, invoice_number,
        invoice_date::VARCHAR, printf('%.2f', amount), currency, po_number, bank_fingerprint,
        CASE WHEN ok % 10 = 7 THEN description END) AS row_text
      FROM (SELECT *, substr(invoice_id, 3, 8)::BIGINT AS ok FROM ledger))
WHERE ok % 10 IN (3, 7)""",
    ),
    "score_csv": _MATCHES,
    "sample_sink": _with(
        LEDGER,
        """SELECT * EXCLUDE (group_id, is_multi, position) FROM (
  SELECT *, row_number() OVER (PARTITION BY is_multi ORDER BY invoice_date, invoice_id) AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY group_id) > 1 AS is_multi FROM ledger))
WHERE position <= 60""",
    ),
    "model_store": _with(
        FEATURE_ROWS,
        " UNION ALL ".join(
            f"SELECT {k}::INT AS position, '{f}' AS feature, round(avg({f}), 6) AS mean, "
            f"round(CASE WHEN min({f}) = max({f}) THEN 1 ELSE stddev_pop({f}) END, 6) AS scale, "
            f"{c}::DOUBLE AS coefficient FROM features"
            for k, (f, _, _, c) in enumerate(_terms(FEATURES))
        ),
    ),
    "threshold_floors": _with(
        JUDGED + "," + GRID,
        "SELECT floor::DOUBLE AS floor, count(*) FILTER (precision >= floor) AS thresholds "
        f"FROM table_ CROSS JOIN (VALUES {', '.join(f'({f}::DOUBLE)' for f in FLOORS)}) v(floor) GROUP BY 1",
    ),
    "logistic_sums": _logistic_sums(),
    "trained_gradient": "SELECT place::INT AS place, 0.0::DOUBLE AS gradient FROM range(1, 11) t(place)",
    "required_columns": _listed_columns(),
    # parts of a run that tell its ledger; standing orders change no row count, id, date, group or null, so not the data quality
    "compare_runs": "SELECT 'other' AS runs, item FROM (VALUES ('parameters'), ('manifest'), ('evaluation'), "
    "('sample')) v(item)",
}
