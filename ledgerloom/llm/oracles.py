"""DuckDB SQL of the corpus operators whose statements are long: written from the contracts, by other ways than the operators'."""

from __future__ import annotations

#: CRC-32 of a text in UTF-8, over a table of 256 remainders (a CTE named crc of one row and column).
CRC_TABLE = """
    crc(tab) AS (
        SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i)
        FROM range(256) t(i)
    )
"""


def crc32(text: str) -> str:
    digits = f"hex(encode({text}))"
    numbers = f"list_transform(range(0, length({digits}), 2), lambda p: ('0x' || substr({digits}, p + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {numbers}), lambda c, x: xor(c >> 8, crc.tab[xor(c, x) & 255 + 1])), 4294967295)".replace("xor(c, x) & 255 + 1", "(xor(c, x) & 255) + 1")


def _then(weight: str, cost: str, label: str) -> str:
    """A weight (nine digits of cost, then labels) after one more arc; null stays null."""
    return f"(lpad((substr({weight}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({weight}, 10) || '{label}')"


def _inserted(w: list[str]) -> list[str]:
    """Weights of the four grammar states (start, s, u, a) after inserts at one place."""
    u = f"least({w[2]}, {', '.join(_then(w[i], '3', 'I') for i in (0, 1, 3))})"
    a = f"least({w[3]}, {_then(u, '3', 'I')})"
    return [w[0], w[1], u, a]


def _conversation() -> str:
    before = ["v0", "v1", "v2", "v3"]
    keep, gone = (lambda w: _then(w, "late", "K")), (lambda w: _then(w, "4", "D"))
    give = lambda w: _then(w, "3 + late", "R")
    may = lambda initial, w: f"CASE WHEN NOT lost AND initial = '{initial}' THEN {w} END"
    when = lambda w: f"CASE WHEN NOT lost THEN {w} END"
    least = lambda *ws: f"least({', '.join(ws)})"
    step = [
        gone("v0"),
        least(gone("v1"), may("s", keep("v0"))),
        least(gone("v2"), *[may("u", keep(v)) for v in ("v0", "v1", "v3")], *[when(give(v)) for v in ("v0", "v1", "v3")]),
        least(gone("v3"), may("a", keep("v2")), when(give("v2"))),
    ]
    insert, end = _inserted(["w0", "w1", "w2", "w3"]), _inserted(before)
    white = r"[\x20\x09-\x0D]"
    return rf"""
    WITH RECURSIVE {CRC_TABLE}, k AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind
        FROM conversations, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM k, (SELECT unnest(range(2)) AS again) WHERE kind <> 0 AND (again = 0 OR kind = 3)
    ), numbered AS (
        SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
               lag(left(role, 1)) OVER w AS before
        FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ), faulty AS (
        SELECT *, left(role, 1) AS initial, CASE WHEN regexp_replace(text, '{white}', '', 'g') = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate'
               WHEN right(regexp_replace(text, '{white}', '', 'g'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered)
    ), r AS (
        SELECT *, fault IN ('blank', 'duplicate') AS lost, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM faulty
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM r GROUP BY conv_id
    ), path(conv_id, i, n, w0, w1, w2, w3) AS (
        SELECT conv_id, 0::BIGINT, max(n), '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM r GROUP BY conv_id
        UNION ALL
        SELECT conv_id, i, n, {step[0]}, {step[1]}, {step[2]}, {step[3]}
        FROM (
            SELECT p.conv_id, p.i + 1 AS i, p.n, r.lost, r.late, r.initial, {', '.join(f'{x} AS v{k}' for k, x in enumerate(insert))}
            FROM path p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
        )
    ), best AS (
        SELECT conv_id, n, least({end[0]}, {end[3]}) AS w FROM (SELECT conv_id, n, w0 AS v0, w1 AS v1, w2 AS v2, w3 AS v3 FROM path WHERE i = n)
    ), walk(conv_id, w, spot, i, state, made) AS (
        SELECT conv_id, w, 10, 0::BIGINT, 0, NULL::VARCHAR FROM best
        UNION ALL
        SELECT conv_id, w, spot + 1, i + (label <> 'I')::INTEGER,
               CASE WHEN label = 'D' THEN state WHEN label = 'K' THEN (CASE initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END) WHEN state = 2 THEN 3 ELSE 2 END,
               CASE WHEN label = 'D' THEN made ELSE coalesce(made || chr(10), '') || CASE label WHEN 'K' THEN role || ':' || text
                    ELSE (CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END) || ':' || CASE WHEN label = 'R' THEN text ELSE '' END END END
        FROM (
            SELECT k.conv_id, k.w, k.spot, k.i, k.state, k.made, substr(k.w, k.spot, 1) AS label, r.role, r.text, r.initial
            FROM walk k LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM k.conv_id AND r.i = k.i + 1 WHERE k.spot <= length(k.w)
        )
    ), done AS (
        SELECT conv_id, substr(w, 1, 9)::BIGINT AS cost, substr(w, 10) AS audit, sha256(coalesce(made, '')) AS repaired_sha256 FROM walk WHERE spot > length(w)
    )
    SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
           coalesce(c.illegal, 0) AS illegal, coalesce(d.cost, 0) AS cost, coalesce(d.audit, '') AS audit, coalesce(d.repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
    """


CONVERSATION_SQL = _conversation()

SPELLING_SQL = f"""
    WITH RECURSIVE {CRC_TABLE}, runs AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ), lowered AS (
        SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM runs GROUP BY ALL
    ), hashed AS (
        SELECT run, times, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM lowered, crc
    ), spelt AS (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2) ELSE run END AS word, times FROM hashed
    ), words AS (
        SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
    ), cut AS (
        SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 1000) t(i) WHERE i <= length(word)
    ), near AS (
        SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT c.word, c.rest FROM cut c JOIN words w ON w.word = c.rest
        UNION SELECT c.rest, c.word FROM cut c JOIN words w ON w.word = c.rest
    ), best AS (
        SELECT x.word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS form, max(w.n) AS form_n FROM near x JOIN words w ON w.word = x.near GROUP BY x.word
    ), forms AS (
        SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 5 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 5 * w.n THEN b.form_n END AS form_n
        FROM words w LEFT JOIN best b USING (word)
    ), chain(word, root) AS (
        SELECT word, word FROM forms
        UNION ALL
        SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
    FROM forms f JOIN chain c ON c.word = f.word JOIN forms g ON g.word = c.root AND g.form IS NULL
"""

EMBEDDING_SQL = """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
    ), reach(vec_id, root) AS (
        SELECT vec_id, vec_id FROM embeddings
        UNION
        SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
    ), least AS (
        SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id
    ), counted AS (
        SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
    )
    SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
    FROM embeddings e JOIN least l USING (vec_id) LEFT JOIN counted c USING (vec_id)
"""
