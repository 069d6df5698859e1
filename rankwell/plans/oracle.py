"""SQL with the same meaning as the queries, for DuckDB on the same tables."""

from __future__ import annotations

import re

from ..functions.text import (
    MAX_MODEL_TOKENS,
    PREVIEW_CHARS,
    PUNCTUATION_PATTERN,
    TOKEN_PATTERN,
    stop_words,
)
from ..operators.context import INSTRUCTION
from ..operators.embedding import LETTERS
from ..operators.fusion import RRF_CONSTANT
from ..operators.lexical import K1, B
from .catalog import (
    BM25_GRID,
    FUSION_WEIGHTS,
    K_SWEEP,
    MAX_PROBES,
    PROBE_SWEEP,
    TOP_K,
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(items) -> str:
    return ", ".join(f"({item})" for item in items)


# --- shared fragments ----------------------------------------------------------------

TOKENS = f"regexp_extract_all(text, {_quoted(TOKEN_PATTERN)})"


def _stop_list() -> str:
    return "[" + ", ".join(_quoted(w) for w in stop_words()) + "]"


NOT_STOP = f"NOT list_contains({_stop_list()}, lower(t))"
NOT_PUNCT = f"NOT regexp_matches(t, {_quoted(PUNCTUATION_PATTERN)})"
CONTENT = f"list_filter({TOKENS}, lambda t: {NOT_STOP} AND {NOT_PUNCT})"


def _token_rows(key: str, table: str, tokens: str) -> str:
    return f"""
        SELECT {key}, CAST(len(tokens) AS INTEGER) AS n_tokens,
               coalesce(array_to_string(tokens, ' '), '') AS tokens
        FROM (SELECT *, {tokens} AS tokens FROM {table})"""


def _lexical(documents: str) -> str:
    """Term statistics of a corpus ``(doc_id, text)``."""
    return f"""
    raw AS (
        SELECT doc_id, term, count(*) AS f
        FROM (SELECT doc_id, unnest({CONTENT}) AS term FROM {documents})
        GROUP BY doc_id, term),
    terms AS (
        SELECT term, CAST(sum(f) AS BIGINT) AS cf, count(*) AS df FROM raw GROUP BY term),
    post AS (
        SELECT doc_id, term, f FROM raw JOIN terms USING (term) WHERE cf > 1),
    lens AS (
        SELECT doc_id, CAST(coalesce(sum(f), 0) AS BIGINT) AS doc_len
        FROM {documents} LEFT JOIN post USING (doc_id) GROUP BY doc_id),
    stats AS (SELECT count(*) AS n_docs, avg(doc_len) AS avg_doc_len FROM lens),
    idfs AS (
        SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf
        FROM terms, stats WHERE cf > 1)"""

def _asked(questions: str) -> str:
    """Weighted terms of ``(query_id, text)`` and their postings."""
    return f"""
    weighted AS (
        SELECT query_id, term, df, qf * idf AS weight
        FROM (SELECT query_id, term, count(*) AS qf
              FROM (SELECT query_id, unnest({CONTENT}) AS term FROM {questions})
              GROUP BY query_id, term)
        JOIN idfs USING (term)),
    matches AS (
        SELECT query_id, doc_id, weight, f, doc_len / avg_doc_len AS relative
        FROM weighted JOIN post USING (term) JOIN lens USING (doc_id), stats)"""


def _grown() -> str:
    """Both steps at once: the first row of a question by step and id, numbered in that order."""
    return f"""{_with(PAIRS)},
    steps AS (
        SELECT 0 AS step, id AS original_id, question, chunk AS text, 'conversations' AS dataset_name FROM pairs
        UNION ALL
        SELECT 1, printf('d%019d', doc_id), text, coalesce(text, ''), 'documents' FROM documents),
    docs AS (
        SELECT row_number() OVER (ORDER BY step, original_id) - 1 AS doc_id, *
        FROM (SELECT * FROM steps
              QUALIFY row_number() OVER (PARTITION BY question ORDER BY step, original_id) = 1)),
    {_lexical("docs")}"""


QUESTIONS = "(SELECT item_id AS query_id, text FROM benchmark)"
LEXICAL = _lexical("documents")
ASKED = _asked(QUESTIONS)


def _part(k1: object, b: object) -> str:
    return f"weight * f * ({k1} + 1) / (f + {k1} * (1 - {b} + {b} * relative))"


SCORED = f"""
    scored AS (
        SELECT query_id, doc_id, round(sum({_part(K1, B)}), 6) AS score
        FROM matches GROUP BY query_id, doc_id)"""

COVERED = """
    truth AS (
        SELECT query_id, doc_id
        FROM (SELECT query_id, doc_id, count(*) AS found
              FROM weighted JOIN post USING (term) GROUP BY query_id, doc_id)
        JOIN (SELECT query_id, count(*) AS n_terms FROM weighted GROUP BY query_id)
        USING (query_id)
        WHERE found = n_terms)"""

CONTAINED = """
    truth AS (
        SELECT q.item_id AS query_id, d.doc_id FROM benchmark q, documents d
        WHERE contains(d.text, q.text))"""


COMPLETE = 2**62  # places of a list: all of them


def _ranked(source: str, k: int, by: str = "query_id") -> str:
    """The best k rows per group of a scored table."""
    return f"""
        SELECT * FROM (
            SELECT *, CAST(row_number() OVER (
                PARTITION BY {by} ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM {source})
        WHERE rank <= {k}"""


def _padded_hits(k: int, questions: str = QUESTIONS, documents: str = "documents") -> str:
    """Zero-score documents fill up: here every question simply meets every document."""
    return f"""
    every AS (SELECT query_id, doc_id FROM {questions} CROSS JOIN {documents}),
    filled AS (
        SELECT query_id, doc_id, coalesce(score, 0.0) AS score
        FROM every LEFT JOIN scored USING (query_id, doc_id)),
    hits AS ({_ranked("filled", k)})"""


VECTORS = """
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    parts AS (
        SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e),
    means AS (
        SELECT label AS cluster, pos, avg(x) AS m FROM parts GROUP BY label, pos),
    centroids AS (
        SELECT cluster, list(m ORDER BY pos) AS c FROM means GROUP BY cluster),
    distances AS (
        SELECT vec_id, label, v, cluster,
               round(list_sum(list_transform(list_zip(v, c),
                     lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2
        FROM e, centroids),
    routes AS (
        SELECT *, CAST(row_number() OVER (
            PARTITION BY vec_id ORDER BY d2, cluster) AS INTEGER) AS route_rank
        FROM distances),
    assigned AS (SELECT * FROM routes WHERE route_rank = 1)"""

COSINES = """
    cosines AS (
        SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
               round(list_inner_product(a.v, b.v)
                     / (sqrt(list_inner_product(a.v, a.v))
                        * sqrt(list_inner_product(b.v, b.v))), 6) + 0.0 AS score
        FROM e a JOIN e b ON a.vec_id <> b.vec_id)"""


def _exact(k: int, name: str = "exact") -> str:
    return f"{name} AS ({_ranked('cosines', k)})"


def _probed(n: int, k: int, name: str = "routed") -> str:
    """Best k among the documents of the n nearest clusters."""
    return f"""
    {name}_scored AS (
        SELECT query_id, doc_id, score
        FROM cosines
        JOIN assigned ON doc_id = assigned.vec_id
        JOIN routes ON query_id = routes.vec_id AND routes.cluster = assigned.cluster
        WHERE routes.route_rank <= {n}),
    {name} AS ({_ranked(f'{name}_scored', k)})"""


def _fused(parts: dict[str, float], k: int) -> str:
    union = " UNION ALL ".join(
        f"SELECT query_id, doc_id, CAST({w} AS DOUBLE) / ({RRF_CONSTANT} + rank) AS part FROM {name}"
        for name, w in parts.items()
    )
    return f"""
    fused_scored AS (
        SELECT query_id, doc_id, round(sum(part), 9) AS score
        FROM ({union}) GROUP BY query_id, doc_id),
    fused AS ({_ranked('fused_scored', k)})"""


def _fusion(weights: dict[str, float], k: int) -> str:
    return ",".join(
        [
            VECTORS,
            COSINES,
            _exact(COMPLETE, "cosine"),
            _probed(1, COMPLETE, "centroid_1"),
            _probed(MAX_PROBES, COMPLETE, "centroid_3"),
            _fused(weights, k),
        ]
    )


RANKING = "query_id, rank, doc_id, score"
EQUAL_WEIGHTS = dict.fromkeys(FUSION_WEIGHTS, 1.0)


def _by_label(hits: str) -> str:
    """Rank of the first hit with the question's label."""
    return f"""
    ranks AS (
        SELECT q.vec_id AS query_id, min(CASE WHEN d.label = q.label THEN rank END) AS rank
        FROM e q LEFT JOIN {hits} h ON h.query_id = q.vec_id
        LEFT JOIN e d ON d.vec_id = h.doc_id
        GROUP BY q.vec_id)"""


def _report(ranks: str = "ranks", extra: str = "") -> str:
    group = f"{extra}, k" if extra else "k"
    return f"""
        SELECT {group}, count(*) AS n_questions,
               round(avg(CASE WHEN rank <= k THEN 1.0 ELSE 0.0 END), 6) AS success,
               round(avg(CASE WHEN rank <= k THEN 1.0 / rank ELSE 0.0 END), 6) AS mrr
        FROM {ranks}, (SELECT CAST(k AS INTEGER) AS k FROM (VALUES {_values(K_SWEEP)}) v(k))
        GROUP BY {group}"""


BM25_RANKS = f"""
    ranks AS (
        SELECT item_id AS query_id, rank
        FROM benchmark LEFT JOIN (
            SELECT query_id, min(rank) AS rank
            FROM hits JOIN truth USING (query_id, doc_id) GROUP BY query_id) f
        ON item_id = f.query_id)"""

POSITIONED = """
    positioned AS (
        SELECT doc_id, n_chars, length(CAST(n_chars AS VARCHAR)) AS cluster,
               row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position
        FROM documents),
    split AS (
        SELECT *, CASE WHEN position < (SELECT count(*) FROM documents) * 9 // 10
                       THEN 'train' ELSE 'test' END AS split
        FROM positioned)"""

PAIRS = """
    pairs AS (
        SELECT printf('%019d-%019d', q.conv_id, q.turn) AS id, q.text AS question, a.text AS chunk
        FROM conversations q JOIN conversations a
          ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
        WHERE q.role = 'user' AND a.role = 'assistant')"""

# The question-document corpus: first row per question, numbered in order of its id.
NUMBERED = f"""{PAIRS},
    numbered AS (
        SELECT row_number() OVER (ORDER BY id) - 1 AS doc_id, question, chunk
        FROM pairs WHERE id IN (SELECT min(id) FROM pairs GROUP BY question)),
    chunks AS (SELECT doc_id, chunk AS text FROM numbered),
    own_questions AS (SELECT doc_id AS query_id, question AS text FROM numbered)"""

SILHOUETTE = """
    gaps AS (
        SELECT a.vec_id, a.label AS own, b.label AS other,
               {distance} AS d
        FROM e a, e b),
    sums AS (SELECT vec_id, own, other, sum(d) AS total FROM gaps GROUP BY vec_id, own, other),
    sizes AS (SELECT label, count(*) AS n FROM e GROUP BY label),
    ab AS (
        SELECT vec_id, own,
               max(CASE WHEN own = other AND n > 1 THEN total / (n - 1) END) AS a,
               min(CASE WHEN own <> other THEN total / n END) AS b
        FROM sums JOIN sizes ON other = label GROUP BY vec_id, own),
    silhouettes AS (
        SELECT vec_id, own AS cluster,
               coalesce((b - a) / nullif(greatest(a, b), 0), 0) AS s
        FROM ab)"""

# K-means over ``source`` (vec_id, v): farthest-first seeds, then rounds until no center
# moves. The last round's centers are those of the fit.
KMEANS = """
    seeds{k} AS (
        SELECT 1 AS n, [arg_min(v, vec_id)] AS c FROM {source}
        UNION ALL
        SELECT n + 1, list_append(any_value(c), arg_max(v, (d2, -vec_id)))
        FROM (SELECT s.n, s.c, p.v, p.vec_id, round(list_min(list_transform(s.c, lambda y:
                     list_sum(list_transform(list_zip(p.v, y),
                              lambda q: (q[1] - q[2]) * (q[1] - q[2]))))), 6) AS d2
              FROM seeds{k} s, {source} p WHERE s.n < {k})
        GROUP BY n),
    rounds{k} AS (
        SELECT 0 AS round, c AS centers, CAST(NULL AS DOUBLE[][]) AS old,
               CAST(NULL AS DOUBLE) AS inertia
        FROM seeds{k} WHERE n = {k}
        UNION ALL
        SELECT round + 1, list(c ORDER BY pick), any_value(centers), sum(d2)
        FROM (
            SELECT round, pick, list(m ORDER BY pos) AS c, any_value(centers) AS centers,
                   any_value(d2) AS d2
            FROM (
                SELECT round, pick, pos, round(avg(x), 9) + 0.0 AS m, sum(d) AS d2,
                       any_value(centers) AS centers
                FROM (
                    SELECT round, centers, ds[pick] AS d, pick, unnest(v) AS x,
                           generate_subscripts(v, 1) AS pos
                    FROM (
                        SELECT *, list_position(rs, list_min(rs)) AS pick
                        FROM (
                            SELECT *, list_transform(ds, lambda d: round(d, 6)) AS rs
                            FROM (
                                SELECT l.round, l.centers, p.v,
                                       list_transform(l.centers, lambda y:
                                           list_sum(list_transform(list_zip(p.v, y),
                                           lambda q: (q[1] - q[2]) * (q[1] - q[2])))) AS ds
                                FROM rounds{k} l, {source} p
                                WHERE l.round < {max_iter}
                                  AND (l.old IS NULL OR l.old <> l.centers)))))
                GROUP BY round, pick, pos)
            GROUP BY round, pick)
        GROUP BY round),
    fitted{k} AS (
        SELECT vec_id, CAST(pick - 1 AS INTEGER) AS cluster, rs[pick] AS d2, v
        FROM (
            SELECT *, list_position(rs, list_min(rs)) AS pick
            FROM (
                SELECT p.vec_id, p.v, list_transform(l.centers, lambda y:
                           round(list_sum(list_transform(list_zip(p.v, y),
                           lambda q: (q[1] - q[2]) * (q[1] - q[2]))), 6)) AS rs
                FROM (SELECT centers FROM rounds{k} ORDER BY round DESC LIMIT 1) l,
                     {source} p)))"""

# Which clusters the exact silhouette compares a row with. The bounds of a mean distance
# come from the mean and the variance of the squared distances, here over all pairs.
COMPARED = """
    squares AS (
        SELECT a.vec_id, a.label AS own, b.label AS other,
               {squared} AS d2
        FROM e a, e b),
    sums AS (
        SELECT vec_id, own, other, count(*) AS n, avg(d2) AS m, var_pop(d2) AS v,
               avg(sqrt(d2)) AS mean
        FROM squares GROUP BY vec_id, own, other),
    reach AS (
        SELECT a.vec_id, a.label AS own, b.cluster AS other, sqrt({to_center}) AS z
        FROM e a, centroids b),
    ends AS (SELECT other, min(z) AS near, max(z) AS far FROM reach WHERE own = other GROUP BY other),
    gapped AS (
        SELECT *, greatest(0, z - far, near - z) AS gap
        FROM sums JOIN reach USING (vec_id, own, other) JOIN ends USING (other)),
    bounds AS (
        SELECT *, sqrt(m) AS upper,
               greatest(z, gap, sqrt(m) * (1 - v / (2 * pow(1 + gap / sqrt(m), 2) * m * m)))
                   * (1 - 1e-7) AS lower,
               row_number() OVER (PARTITION BY vec_id ORDER BY own = other, m, other) = 1 AS home
        FROM gapped),
    homes AS (SELECT vec_id, mean AS best FROM bounds WHERE home),
    compared AS (
        SELECT vec_id, sum(n) AS compared
        FROM bounds JOIN homes USING (vec_id)
        WHERE home OR own = other OR lower <= best GROUP BY vec_id)"""

SQUARED = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

CONFUSION = """
    confusion AS (
        SELECT label, cluster AS pred, count(*) AS n FROM assigned GROUP BY label, cluster),
    classes AS (SELECT label AS class FROM confusion UNION SELECT pred FROM confusion),
    counts AS (
        SELECT class,
               (SELECT coalesce(sum(n), 0) FROM confusion WHERE label = class) AS support,
               (SELECT coalesce(sum(n), 0) FROM confusion WHERE pred = class) AS predicted,
               (SELECT coalesce(sum(n), 0) FROM confusion
                WHERE label = class AND pred = class) AS hits
        FROM classes),
    ratios AS (
        SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision,
                  coalesce(hits / nullif(support, 0), 0) AS recall
        FROM counts),
    measured AS (
        SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1
        FROM ratios)"""

UNIT = """
    unit AS (
        SELECT vec_id, CAST(list_transform(v,
                   lambda x: CAST(x / sqrt(list_inner_product(v, v)) AS FLOAT)) AS FLOAT[]) AS u
        FROM e)"""


def _components(key: str, vector: str, source: str) -> str:
    return f"""
        SELECT {key}, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(x AS DOUBLE), 6) + 0.0 AS value
        FROM (SELECT {key}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS pos
              FROM {source})"""


def _context() -> str:
    return """
    contexts AS (
        SELECT query_id,
               string_agg('[' || rank || '] ' || text || chr(10) || chr(10), '' ORDER BY rank)
                   AS context
        FROM hits JOIN documents USING (doc_id) GROUP BY query_id)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


def _kmeans(source: str, k: int, max_iter: int = 300) -> str:
    return KMEANS.format(source=source, k=k, max_iter=max_iter)


def _sweep(ks: range) -> str:
    """Inertia and silhouette on squared distances of the fits for several k."""
    fits, measured = [], []
    for k in ks:
        fits.append(_kmeans("points", k))
        renamed = SILHOUETTE.format(distance=SQUARED)
        for name in ("gaps", "sums", "sizes", "ab", "silhouettes"):
            renamed = re.sub(rf"\b{name}\b", f"{name}{k}", renamed)
        renamed = re.sub(r"\be ([ab])\b", rf"labelled{k} \1", renamed)
        renamed = renamed.replace("FROM e GROUP", f"FROM labelled{k} GROUP")
        fits.append(f"""
    labelled{k} AS (SELECT vec_id, cluster AS label, v FROM fitted{k}),{renamed}""")
        measured.append(f"""
            SELECT {k} AS k, (SELECT round(sum(d2), 4) FROM fitted{k}) AS inertia,
                   (SELECT round(avg(s), 6) + 0.0 FROM silhouettes{k}) AS silhouette""")
    return f"""
        WITH RECURSIVE {VECTORS}, points AS (SELECT vec_id, v FROM e),{",".join(fits)},
        swept AS ({" UNION ALL ".join(measured)})
        SELECT k, inertia, silhouette,
               row_number() OVER (ORDER BY silhouette DESC, k) = 1 AS best FROM swept"""


def _letters(name: str, key: str, source: str) -> str:
    counts = ", ".join(f"CAST(length(text) - length(replace(text, '{c}', '')) AS DOUBLE)" for c in LETTERS)
    return f"""
    {name} AS (SELECT {key}, [{counts}] AS v FROM {source})"""


LETTER_COSINES = """
    letter_cosines AS (
        SELECT query_id, doc_id,
               round(list_inner_product(a.v, b.v)
                     / (sqrt(list_inner_product(a.v, a.v))
                        * sqrt(list_inner_product(b.v, b.v))), 6) + 0.0 AS score
        FROM letters_asked a, letters b
        WHERE list_inner_product(a.v, a.v) > 0 AND list_inner_product(b.v, b.v) > 0)"""


def _fused_bm25(k: int) -> str:
    return ",".join(
        [
            LEXICAL,
            ASKED,
            SCORED,
            f"bm25 AS ({_ranked('scored', COMPLETE)})",
            _letters("letters", "doc_id", "documents"),
            _letters("letters_asked", "query_id", QUESTIONS),
            LETTER_COSINES,
            f"letter_hits AS ({_ranked('letter_cosines', COMPLETE)})",
            _fused({"bm25": 1.0, "letter_hits": 1.0}, k),
        ]
    )


def build() -> dict[str, str]:
    lex = _with(LEXICAL)
    asked = _with(LEXICAL, ASKED, SCORED)
    vec = _with(VECTORS)
    cos = [VECTORS, COSINES]
    before, after = (_quoted(p).replace("\n", "' || chr(10) || '") for p in INSTRUCTION.split("%s"))
    bm25_eval = [LEXICAL, ASKED, SCORED, CONTAINED, _padded_hits(TOP_K), BM25_RANKS]
    grid_probes = [_probed(n, TOP_K, f"routed_{n}") for n in PROBE_SWEEP]
    all_hits = " UNION ALL ".join(
        ["SELECT 0 AS n_clusters, query_id, doc_id, rank FROM exact"]
        + [f"SELECT {n}, query_id, doc_id, rank FROM routed_{n}" for n in PROBE_SWEEP]
    )
    sql = {
        # sources and sinks
        "union_splits": """
            SELECT 'train' AS split, text FROM documents
            UNION ALL SELECT 'test', text FROM conversations
            UNION ALL SELECT 'validation', text FROM benchmark""",
        "jsonl_roundtrip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "append_new_rows": f"""
            SELECT doc_id, CAST(len({CONTENT}) AS INTEGER) AS n_tokens,
                   CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS batch
            FROM documents""",
        "upsert_vectors": f"""
            {_with(VECTORS, UNIT)},
            base AS (
                SELECT vec_id, CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END
                       * list_sum(v) AS total FROM e)
            SELECT vec_id AS original_id, 'base' AS model, CAST(len(v) AS INTEGER) AS dims,
                   round(total, 4) + 0.0 AS total
            FROM base JOIN e USING (vec_id)
            UNION ALL
            SELECT vec_id, 'unit', CAST(len(u) AS INTEGER),
                   round(list_sum(CAST(u AS DOUBLE[])), 4) + 0.0
            FROM unit""",
        "vectors_by_model": f"{_with(VECTORS, UNIT)} {_components('vec_id', 'u', 'unit')}",
        # projections, filters, dedup, ids
        "dedup_first": """
            SELECT doc_id, lang, source FROM documents
            WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""",
        "first_chunk": f"{_with(PAIRS)} SELECT id, chunk FROM pairs",
        "dense_id": f"{_with(POSITIONED)} SELECT doc_id, n_chars, position FROM positioned",
        "filter_clusters": """
            SELECT vec_id AS id, label AS cluster FROM embeddings WHERE label IN (0, 3, 7)""",
        # text
        "tokenize": _token_rows("doc_id", "documents", TOKENS),
        "drop_stopwords": _token_rows(
            "doc_id", "documents", f"list_filter({TOKENS}, lambda t: {NOT_STOP})"
        ),
        "drop_punct": _token_rows(
            "doc_id", "documents", f"list_filter({TOKENS}, lambda t: {NOT_PUNCT})"
        ),
        "tokenize_questions": _token_rows("query_id", QUESTIONS, CONTENT),
        "term_counts": f"{lex} SELECT term, cf FROM terms",
        "prune_rare_terms": f"""
            {lex},
            placed AS (
                SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos
                FROM (SELECT doc_id, {CONTENT} AS tokens FROM documents)),
            kept AS (
                SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY pos) AS tokens
                FROM placed JOIN terms USING (term) WHERE cf > 1 GROUP BY doc_id)
            SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_tokens,
                   coalesce(tokens, '') AS tokens
            FROM documents LEFT JOIN kept USING (doc_id)""",
        "concat_features": f"""
            {_with(PAIRS)} SELECT id, question || ' ' || chunk AS text FROM pairs""",
        "truncate_tokens": _token_rows(
            "doc_id", "documents", f"({TOKENS})[1:{MAX_MODEL_TOKENS}]"
        ),
        "preview": f"""
            {asked}, {_padded_hits(3)}
            SELECT query_id, rank, doc_id, substr(text, 1, {PREVIEW_CHARS}) AS preview
            FROM hits JOIN documents USING (doc_id)""",
        # BM25
        "doc_length": f"{lex} SELECT doc_id, doc_len FROM lens",
        "corpus_stats": f"""
            {lex} SELECT n_docs, round(avg_doc_len, 6) AS avg_doc_len FROM stats""",
        "postings": f"{lex} SELECT doc_id, term, f FROM post",
        "doc_freq": f"{lex} SELECT term, count(*) AS df FROM post GROUP BY term",
        "idf": f"{lex} SELECT term, df, round(idf, 6) AS idf FROM idfs",
        "bm25_scores": f"""
            {asked}, {COVERED}
            SELECT query_id, doc_id, score FROM truth JOIN scored USING (query_id, doc_id)""",
        "bm25_topk": f"{asked} SELECT {RANKING} FROM ({_ranked('scored', TOP_K)})",
        "bm25_topk_padded": f"{asked}, {_padded_hits(TOP_K)} SELECT {RANKING} FROM hits",
        "bm25_param_grid": f"""
            {_with(LEXICAL, ASKED)},
            grid AS (
                SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b
                FROM (VALUES {_values(f'{k1}, {b}' for k1, b in BM25_GRID)}) g(k1, b)),
            scored AS (
                SELECT k1, b, query_id, doc_id, round(sum({_part('k1', 'b')}), 6) AS score
                FROM matches, grid GROUP BY k1, b, query_id, doc_id)
            {_ranked('scored', 3, 'k1, b, query_id')}""",
        # vectors
        "vec_dot": f"""
            {vec} SELECT vec_id AS id, round(list_inner_product(v, c), 6) + 0.0 AS dot
            FROM e JOIN centroids ON label = cluster""",
        "vec_norm": f"""
            {vec} SELECT vec_id AS id, round(sqrt(list_inner_product(v, v)), 6) AS norm,
                         round(sqrt(list_inner_product(c, c)), 6) AS centroid_norm
            FROM e JOIN centroids ON label = cluster""",
        "vec_cosine": f"""
            {vec} SELECT vec_id AS id,
                         round(list_inner_product(v, c) / (sqrt(list_inner_product(v, v))
                               * sqrt(list_inner_product(c, c))), 6) + 0.0 AS cosine
            FROM e JOIN centroids ON label = cluster""",
        "vec_normalize": f"""
            {_with(VECTORS, UNIT)}
            {_components('doc_id', 'u', '(SELECT vec_id AS doc_id, u FROM unit)')}""",
        "vec_dim": """
            SELECT CAST(min(len(embedding)) AS INTEGER) AS dim,
                   count(DISTINCT len(embedding)) AS n_dims FROM embeddings""",
        "ip_topk": f"""
            {_with(VECTORS, UNIT)},
            products AS (
                SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
                       round(list_inner_product(CAST(a.u AS DOUBLE[]), CAST(b.u AS DOUBLE[])), 6)
                           + 0.0 AS score
                FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)
            SELECT {RANKING} FROM ({_ranked('products', TOP_K)})""",
        "cosine_topk_one": f"""
            {vec},
            q AS (SELECT list(m ORDER BY pos) AS c
                  FROM (SELECT pos, avg(x) AS m FROM parts GROUP BY pos))
            SELECT vec_id AS doc_id,
                   round(list_inner_product(v, c) / (sqrt(list_inner_product(v, v))
                         * sqrt(list_inner_product(c, c))), 6) + 0.0 AS score
            FROM e, q ORDER BY score DESC, doc_id LIMIT {TOP_K}""",
        "cosine_topk_batch": f"""
            {_with(*cos)} SELECT {RANKING} FROM ({_ranked('cosines', TOP_K)})""",
        "cosine_topk_rings": f"""
            {_with(*cos)} SELECT {RANKING} FROM ({_ranked('cosines', TOP_K)})""",
        "ip_topk_rings": f"""
            {_with(VECTORS, UNIT)},
            products AS (
                SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
                       round(list_inner_product(CAST(a.u AS DOUBLE[]), CAST(b.u AS DOUBLE[])), 6)
                           + 0.0 AS score
                FROM unit a JOIN unit b ON a.vec_id <> b.vec_id)
            SELECT {RANKING} FROM ({_ranked('products', TOP_K)})""",
        # clustering
        "assign_nearest": f"{vec} SELECT vec_id AS id, cluster, d2 FROM assigned",
        "centroid_means": f"{vec} {_components('cluster', 'c', 'centroids')}",
        "lloyd_step": f"""
            {vec},
            moved AS (
                SELECT cluster, pos, avg(x) AS m
                FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos
                      FROM assigned)
                GROUP BY cluster, pos)
            SELECT cluster, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) + 0.0 AS value
            FROM moved""",
        "inertia": f"{vec} SELECT count(*) AS n, round(sum(d2), 4) AS inertia FROM assigned",
        "silhouette_exact": f"""
            {_with(VECTORS, SILHOUETTE.format(distance=f'sqrt({SQUARED})'))}
            SELECT cluster, count(*) AS n, round(avg(s), 6) + 0.0 AS silhouette
            FROM (SELECT cluster, s FROM silhouettes UNION ALL SELECT -1, s FROM silhouettes)
            GROUP BY cluster""",
        "kmeans_assign": f"""
            WITH RECURSIVE {VECTORS},{_kmeans("e", 4)}
            SELECT vec_id AS id, cluster, d2 FROM fitted4""",
        "kmeans_norm_assign": f"""
            WITH RECURSIVE {VECTORS},{UNIT},
            units AS (SELECT vec_id, CAST(u AS DOUBLE[]) AS v FROM unit),{_kmeans("units", 4, 20)}
            SELECT vec_id AS id, cluster, d2 FROM fitted4""",
        "kmeans_rounds": f"""
            WITH RECURSIVE {VECTORS},{_kmeans("e", 4)}
            SELECT round, round(inertia, 4) + 0.0 AS inertia FROM rounds4 WHERE round > 0""",
        "sweep_k": _sweep(range(2, 6)),
        "silhouette_compared": f"""
            {_with(VECTORS, COMPARED.format(squared=SQUARED, to_center=SQUARED.replace('b.v', 'b.c')))}
            SELECT count(*) AS n, round(avg(compared), 6) AS rows_compared,
                   round(avg(compared) / count(*), 6) AS share FROM compared""",
        "silhouette_ml": f"""
            {_with(VECTORS, SILHOUETTE.format(distance=SQUARED))}
            SELECT count(*) AS n, round(avg(s), 6) + 0.0 AS silhouette FROM silhouettes""",
        "cluster_sizes": """
            SELECT label AS cluster, count(*) AS n,
                   round(count(*) / sum(count(*)) OVER (), 6) AS share
            FROM embeddings GROUP BY label""",
        # splits and classifier
        "split_positional": f"{_with(POSITIONED)} SELECT doc_id, position, split FROM split",
        "missing_clusters": f"""
            {_with(POSITIONED)}
            SELECT CAST(cluster AS INTEGER) AS cluster FROM split
            GROUP BY cluster HAVING count(*) FILTER (split = 'train') = 0""",
        "split_covered": f"""
            {_with(POSITIONED)},
            moved AS (
                SELECT min(position) AS position FROM split
                GROUP BY cluster HAVING count(*) FILTER (split = 'train') = 0)
            SELECT doc_id, CAST(cluster AS INTEGER) AS cluster,
                   CASE WHEN position IN (SELECT position FROM moved)
                        THEN 'train' ELSE split END AS split
            FROM split""",
        "split_hashed": """
            SELECT doc_id,
                   CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT)
                             % 10 = 0 THEN 'test' ELSE 'train' END AS split
            FROM documents""",
        "class_count": "SELECT CAST(max(label) + 1 AS INTEGER) AS n_classes FROM embeddings",
        "accuracy": f"""
            {vec} SELECT count(*) AS n,
                         round(avg(CASE WHEN label = cluster THEN 1.0 ELSE 0.0 END), 6) AS accuracy
            FROM assigned""",
        "classification_report": f"""
            {_with(VECTORS, CONFUSION)}
            SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision,
                   round(recall, 6) AS recall, round(f1, 6) AS f1,
                   CAST(support AS BIGINT) AS support
            FROM measured
            UNION ALL
            SELECT 'accuracy', round(sum(hits) / sum(support), 6),
                   round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
                   CAST(sum(support) AS BIGINT) FROM measured
            UNION ALL
            SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6),
                   round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM measured
            UNION ALL
            SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                   round(sum(recall * support) / sum(support), 6),
                   round(sum(f1 * support) / sum(support), 6),
                   CAST(sum(support) AS BIGINT) FROM measured""",
        "softmax_topn": f"""
            {vec},
            shifted AS (
                SELECT vec_id, cluster, exp(min(d2) OVER (PARTITION BY vec_id) - d2) AS w
                FROM distances),
            probabilities AS (
                SELECT vec_id AS doc_id, cluster,
                       round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS probability
                FROM shifted)
            SELECT doc_id, rank, cluster, probability FROM (
                SELECT *, CAST(row_number() OVER (
                    PARTITION BY doc_id ORDER BY probability DESC, cluster) AS INTEGER) AS rank
                FROM probabilities)
            WHERE rank <= {MAX_PROBES}""",
        # a corpus that grows
        "build_again": f"""{_grown()}
            SELECT doc_id AS id, original_id, dataset_name, doc_len,
                   CAST({' + '.join(f"length(text) - length(replace(text, '{c}', ''))" for c in LETTERS)} AS BIGINT) AS letters,
                   length(text) AS chars
            FROM docs JOIN lens USING (doc_id)""",
        "terms_again": f"{_grown()} SELECT term, cf, df FROM terms WHERE cf > 1",
        # routed retrieval and fusion
        "route_centroids": f"""
            {vec} SELECT vec_id AS query_id, route_rank, cluster, d2
            FROM routes WHERE route_rank <= {MAX_PROBES}""",
        "index_by_cluster": f"{vec} SELECT vec_id AS doc_id, cluster FROM assigned",
        "topk_per_cluster": f"""
            {_with(*cos)},
            probed AS (
                SELECT query_id, routes.cluster, doc_id, score
                FROM cosines
                JOIN assigned ON doc_id = assigned.vec_id
                JOIN routes ON query_id = routes.vec_id AND routes.cluster = assigned.cluster
                WHERE routes.route_rank <= {MAX_PROBES})
            SELECT query_id, cluster, rank, doc_id, score
            FROM ({_ranked('probed', TOP_K, 'query_id, cluster')})""",
        "routed_centroid_topk": f"""
            {_with(*cos, _probed(MAX_PROBES, TOP_K))} SELECT {RANKING} FROM routed""",
        "search_space_share": f"""
            {vec},
            sizes AS (SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster),
            probes AS (
                SELECT CAST(p AS INTEGER) AS n_clusters
                FROM (VALUES {_values(PROBE_SWEEP)}) v(p))
            SELECT n_clusters, round(avg(scanned / total), 6) AS share
            FROM (SELECT n_clusters, vec_id, sum(n) AS scanned
                  FROM probes JOIN routes ON route_rank <= n_clusters
                  JOIN sizes USING (cluster) GROUP BY n_clusters, vec_id),
                 (SELECT count(*) AS total FROM e)
            GROUP BY n_clusters""",
        "rrf_fusion": f"WITH {_fusion(EQUAL_WEIGHTS, TOP_K)} SELECT {RANKING} FROM fused",
        "rrf_weighted": f"WITH {_fusion(FUSION_WEIGHTS, TOP_K)} SELECT {RANKING} FROM fused",
        "rrf_bm25_cosine": f"WITH {_fused_bm25(TOP_K)} SELECT {RANKING} FROM fused",
        "embed_batch": f"""
            {_with(_letters('letters', 'doc_id', 'documents'))}
            {_components('doc_id', 'v', 'letters')}""",
        "retrieve_all_modes": f"""
            {_with(LEXICAL, ASKED, SCORED, _padded_hits(3), *cos, _exact(3), _probed(2, 3),
                   _exact(COMPLETE, 'deep'), _probed(2, COMPLETE, 'deep_routed'),
                   _fused({'deep': 1.0, 'deep_routed': 1.0}, 3))}
            SELECT 'bm25' AS mode, {RANKING} FROM hits
            UNION ALL SELECT 'cosine', {RANKING} FROM exact
            UNION ALL SELECT 'centroid', {RANKING} FROM routed
            UNION ALL SELECT 'rrf', {RANKING} FROM fused""",
        # evaluation
        "truth_rank": f"{_with(*bm25_eval)} SELECT query_id, rank FROM ranks",
        "success_at_k": f"""
            {_with(*cos, _exact(TOP_K), _by_label('exact'))}
            SELECT k, success FROM ({_report()})""",
        "mrr_at_k": f"""
            {_with(*cos, _exact(TOP_K), _by_label('exact'))}
            SELECT k, mrr FROM ({_report()})""",
        "eval_bm25": f"{_with(*bm25_eval)} {_report()}",
        "eval_cosine": f"{_with(*cos, _exact(TOP_K), _by_label('exact'))} {_report()}",
        "eval_routed": f"{_with(*cos, _probed(2, TOP_K), _by_label('routed'))} {_report()}",
        "eval_rrf": f"WITH {_fusion(FUSION_WEIGHTS, TOP_K)}, {_by_label('fused')} {_report()}",
        "eval_rrf_bm25": f"""
            WITH {_fused_bm25(TOP_K)}, {CONTAINED}, hits AS (SELECT * FROM fused), {BM25_RANKS}
            {_report()}""",
        "eval_grid": f"""
            {_with(*bm25_eval, *cos, _exact(TOP_K), *grid_probes)},
            all_hits AS ({all_hits}),
            settings AS (SELECT DISTINCT n_clusters FROM all_hits),
            vector_ranks AS (
                SELECT n_clusters, q.vec_id AS query_id,
                       min(CASE WHEN d.label = q.label THEN rank END) AS rank
                FROM settings CROSS JOIN e q
                LEFT JOIN all_hits h USING (n_clusters)
                LEFT JOIN e d ON d.vec_id = h.doc_id
                WHERE h.query_id = q.vec_id OR h.query_id IS NULL
                GROUP BY n_clusters, q.vec_id)
            SELECT CASE WHEN n_clusters = 0 THEN 'cosine' ELSE 'centroid' END AS mode,
                   n_clusters, k, n_questions, success, mrr
            FROM ({_report('vector_ranks', 'n_clusters')})
            UNION ALL
            SELECT 'bm25', 0, k, n_questions, success, mrr FROM ({_report()})""",
        "eval_bm25_pairs": f"""
            {_with(NUMBERED, _lexical('chunks'), _asked('own_questions'), SCORED,
                   _padded_hits(TOP_K, 'own_questions', 'chunks'))},
            ranks AS (
                SELECT q.query_id, min(CASE WHEN doc_id = q.query_id THEN rank END) AS rank
                FROM own_questions q LEFT JOIN hits USING (query_id) GROUP BY q.query_id)
            {_report()}""",
        # context and streaming
        "build_context": f"""
            {asked}, {_padded_hits(3)}, {_context()} SELECT query_id, context FROM contexts""",
        "build_prompts": f"""
            {asked}, {_padded_hits(3)}, {_context()}
            SELECT query_id, 'system' AS first_role,
                   {before} || context || {after} AS first_content,
                   'user' AS second_role, text AS second_content
            FROM contexts JOIN benchmark ON item_id = query_id""",
        "stream_questions": f"{asked}, {_padded_hits(TOP_K)} SELECT {RANKING} FROM hits",
    }
    sql["upsert_written"] = sql["upsert_vectors"]
    return sql
