"""The same results in DuckDB's SQL, written with other methods where possible.

Plans are replayed step by step with recursive queries over explicit states, where
the library uses windows over fact timelines and running hashes.
"""

from __future__ import annotations

from planloom import catalog
from planloom.schemas import SPECIAL_TOKENS, VOCABULARY_SIZE
from planloom.sources.texts import TEXT_FACTS

ORACLES: dict[str, str] = {}

N_SPECIAL = len(SPECIAL_TOKENS)

LINES = """
l AS (
  SELECT l_orderkey AS plan_id, o_custkey,
         'part' || l_partkey AS part, 'supp' || l_suppkey AS supp, 'cust' || o_custkey AS cust,
         l_quantity <= 45 AS stocked, l_returnflag = 'R' AS ret,
         (l_linestatus = 'O' AND l_tax = 0.08) AS recalled, l_discount = 0.10 AS swapped,
         CAST(1 + SUM(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) OVER w
              - CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END AS BIGINT) AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey,
               l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
s AS (
  SELECT plan_id, o_custkey, seq, seq AS step,
         CASE WHEN recalled THEN 'RECALL-PART' ELSE 'SHIP-PART' END AS op, part AS a1,
         CASE WHEN swapped THEN cust ELSE supp END AS a2, CASE WHEN swapped THEN supp ELSE cust END AS a3
  FROM l
  UNION ALL
  SELECT plan_id, o_custkey, seq, seq + 1, 'RETURN-PART', part, cust, supp FROM l WHERE ret
),
t AS (SELECT *, replace(op, '-', '') || upper(a1 || a2 || a3) AS token, op <> 'RECALL-PART' AS known,
             op || '_' || a1 || '_' || a2 || '_' || a3 AS decoded FROM s)
"""

# Sizes of all plans, those without lines too, and every token with its place in its section.
SIZES = """
z AS (
  SELECT o_orderkey AS plan_id, orders.o_custkey, count(*) FILTER (stocked) AS n_initial_state,
         count(l.plan_id) AS n_goals, CAST(coalesce(sum(CASE WHEN ret THEN 2 WHEN NOT ret THEN 1 END), 0) AS BIGINT) AS n_actions
  FROM orders LEFT JOIN l ON l.plan_id = o_orderkey GROUP BY 1, 2
)
"""

TOKENS = """
k AS (
  SELECT plan_id, 'initial_state' AS section, row_number() OVER (PARTITION BY plan_id ORDER BY seq) - 1 AS place,
         'at' || part || supp AS token, 'at_' || part || '_' || supp AS pretty FROM l WHERE stocked
  UNION ALL
  SELECT plan_id, 'goals', row_number() OVER (PARTITION BY plan_id ORDER BY seq) - 1, 'at' || part || cust, 'at_' || part || '_' || cust FROM l
  UNION ALL SELECT plan_id, 'actions', step - 1, token, NULL FROM t
)
"""

# Full sequences; the numbers 0 to 3 put the sections and the marks before them in order.
SEQUENCES = """
q AS (
  SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY section_no, place) - 1 AS position, token
  FROM (
    SELECT plan_id, CASE section WHEN 'initial_state' THEN 0 WHEN 'goals' THEN 1 ELSE 2 END AS section_no, place, token FROM k
    UNION ALL SELECT plan_id, unnest([0, 1, 2, 3]), -1, unnest(['<|startofplan|>', '<|goals|>', '<|actions|>', '<|endofplan|>']) FROM z
  )
)
"""

# The state after every step, as a sorted list of facts.
STATES = """
i0 AS (
  SELECT o_orderkey AS plan_id, coalesce(list_sort(list_distinct(list('at' || part || supp) FILTER (stocked))), []) AS facts
  FROM orders LEFT JOIN l ON l.plan_id = o_orderkey GROUP BY 1
),
st AS (
  SELECT plan_id, CAST(0 AS BIGINT) AS step, facts FROM i0
  UNION ALL
  SELECT st.plan_id, t.step,
         CASE WHEN t.known THEN
           list_sort(list_distinct(list_append(
             list_filter(st.facts, lambda f: f <> 'at' || t.a1 || t.a2), 'at' || t.a1 || t.a3)))
         ELSE st.facts END
  FROM st JOIN t ON t.plan_id = st.plan_id AND t.step = st.step + 1
),
fin AS (SELECT plan_id, arg_max(facts, step) AS facts FROM st GROUP BY plan_id),
goal AS (SELECT DISTINCT plan_id, 'at' || part || cust AS fact FROM l)
"""

# What each customer's problem lists.
OBJECTS = """
obj AS (
  SELECT DISTINCT o_custkey, part AS name, 'part' AS type FROM l JOIN part p ON l.part = 'part' || p_partkey WHERE p_size <> 50
  UNION ALL SELECT DISTINCT o_custkey, supp, 'supplier' FROM l JOIN supplier ON supp = 'supp' || s_suppkey
  UNION ALL SELECT c_custkey, 'cust' || c_custkey, 'customer' FROM customer
)
"""

CLASSES = """
pre AS (
  SELECT t.plan_id, min(t.step) AS step FROM t JOIN st ON st.plan_id = t.plan_id AND st.step = t.step - 1
  WHERE t.known AND NOT list_contains(st.facts, 'at' || t.a1 || t.a2) GROUP BY 1
),
arg AS (
  SELECT plan_id, o_custkey, a1 AS name, 'part' AS wanted FROM t WHERE known
  UNION ALL SELECT plan_id, o_custkey, a2, CASE WHEN op = 'SHIP-PART' THEN 'supplier' ELSE 'customer' END FROM t WHERE known
  UNION ALL SELECT plan_id, o_custkey, a3, CASE WHEN op = 'SHIP-PART' THEN 'customer' ELSE 'supplier' END FROM t WHERE known
),
argx AS (SELECT plan_id, bool_or(type IS NULL) AS unknown, coalesce(bool_or(type <> wanted), false) AS wrong
         FROM arg LEFT JOIN obj USING (o_custkey, name) GROUP BY 1),
bad AS (SELECT DISTINCT plan_id FROM t WHERE NOT known),
open AS (SELECT DISTINCT goal.plan_id FROM goal JOIN fin USING (plan_id) WHERE NOT list_contains(facts, fact)),
cl AS (
  SELECT i0.plan_id, CAST(i0.plan_id % 6 AS INTEGER) AS actions_seen, pre.step AS pre_step,
         CASE WHEN bad.plan_id IS NOT NULL THEN 'bad_operator_error'
              WHEN argx.unknown THEN 'unknown_type_error'
              WHEN argx.wrong THEN 'type_checking_error'
              WHEN pre.plan_id IS NOT NULL THEN 'precondition_error'
              WHEN open.plan_id IS NOT NULL THEN 'unsatisfied_goal_error'
              ELSE 'valid' END AS class
  FROM i0 LEFT JOIN bad USING (plan_id) LEFT JOIN argx USING (plan_id)
  LEFT JOIN pre USING (plan_id) LEFT JOIN open USING (plan_id)
)
"""

FUNNEL_STEPS = """
e AS (
  SELECT 'u' || user_id || '_' || strftime(date_trunc('week', ts), '%Y%m%d') AS plan_id, user_id,
         date_trunc('week', ts) AS week, upper(event_type) AS op,
         row_number() OVER (PARTITION BY user_id, date_trunc('week', ts) ORDER BY ts, event_id) AS step
  FROM events
)
"""

# Four truth values per plan: registered, viewing, clicked, bought.
FUNNEL_STATES = """
fs AS (
  SELECT DISTINCT plan_id, user_id, CAST(0 AS BIGINT) AS step, true AS reg, true AS viewing, true AS clicked, false AS bought FROM e
  UNION ALL
  SELECT fs.plan_id, fs.user_id, e.step,
         reg OR op = 'SIGNUP',
         CASE WHEN op = 'VIEW' THEN true WHEN op IN ('CLICK', 'ERROR') THEN false ELSE viewing END,
         CASE WHEN op = 'CLICK' THEN true WHEN op IN ('PURCHASE', 'ERROR') THEN false ELSE clicked END,
         bought OR op = 'PURCHASE'
  FROM fs JOIN e ON e.plan_id = fs.plan_id AND e.step = fs.step + 1
),
probe AS (
  SELECT e.plan_id, e.step,
         CASE op WHEN 'VIEW' THEN 'registered' WHEN 'CLICK' THEN 'viewing' ELSE 'clicked' END || 'u' || e.user_id AS fact,
         CASE op WHEN 'VIEW' THEN reg WHEN 'CLICK' THEN viewing ELSE clicked END AS holds
  FROM e JOIN fs ON fs.plan_id = e.plan_id AND fs.step = e.step - 1
  WHERE op IN ('VIEW', 'CLICK', 'PURCHASE')
)
"""

CORPUS_TOKENS = """
tok AS (
  SELECT token FROM t
  UNION ALL SELECT 'at' || part || supp FROM l WHERE stocked
  UNION ALL SELECT 'at' || part || cust FROM l
)
"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)


def _special(as_type: str = "BIGINT") -> str:
    rows = [f"('{token}', CAST({i} AS {as_type}), CAST(0 AS BIGINT))" for i, token in enumerate(SPECIAL_TOKENS)]
    return "VALUES " + ", ".join(rows)


def _vocabulary(source: str, size: int | str = VOCABULARY_SIZE) -> str:
    """CTEs that make ``vocab(token, token_id, frequency)`` of ``source(token)``."""
    return f"""
    counted AS (SELECT token, count(*) AS frequency FROM {source} GROUP BY 1),
    learned AS (
      SELECT token, row_number() OVER (ORDER BY frequency DESC, token) + {N_SPECIAL - 1} AS token_id, frequency
      FROM counted QUALIFY row_number() OVER (ORDER BY frequency DESC, token) <= {size} - {N_SPECIAL}
    ),
    vocab(token, token_id, frequency) AS ({_special()} UNION ALL SELECT token, token_id, frequency FROM learned)
    """


def _md5_key(key: str, seed: int = 7) -> str:
    return f"md5('{seed}|' || {key})"


def _bits(key: str, seed: int = 7) -> str:
    return f"CAST(('0x' || substr({_md5_key(key, seed)}, 1, 13)) AS BIGINT)"


def _score_table(source: str, skipped: str = "CAST(0 AS BIGINT)", buckets: int = 6) -> str:
    classes = [
        "valid", "precondition_error", "type_checking_error", "unknown_type_error",
        "bad_operator_error", "unsatisfied_goal_error", "missing_problem",
    ]
    counts = ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in classes)
    return (
        f"SELECT actions_seen, count(class) AS total, {counts}, {skipped} AS skipped FROM "
        f"(SELECT CAST(unnest(range({buckets})) AS INTEGER) AS actions_seen) b "
        f"FULL JOIN {source} USING (actions_seen) GROUP BY 1"
    )


ORACLES["plan_records"] = _with(LINES, SIZES) + """
SELECT plan_id, 'xml-GEN-cust' || o_custkey || '_' || plan_id || '.SOL' AS name, 'cust' || o_custkey || '.pddl' AS pddl_problem_file,
       n_initial_state AS len_initial_state, n_goals AS len_goals, n_actions AS len_plan,
       n_initial_state + n_goals + 2 AS actions_idx, n_initial_state + n_goals + n_actions + 3 AS eop_idx FROM z"""

ORACLES["record_tokens"] = _with(LINES, TOKENS) + "SELECT plan_id, section, place, token FROM k"

ORACLES["plan_sizes"] = _with(LINES, SIZES) + "SELECT plan_id, n_initial_state, n_goals, n_actions FROM z"

ORACLES["corpus_stats"] = _with(LINES, SIZES) + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count(*) AS n_plans, round(avg(n_{m}), 6) AS mean, round(stddev_samp(n_{m}), 6) AS std, "
    f"min(n_{m}) AS min, max(n_{m}) AS max, round(median(n_{m}), 6) AS median FROM z"
    for m in ("initial_state", "goals", "actions")
)

ORACLES["problem_ids"] = """
SELECT 'cust' || o_custkey AS problem_id, count(*) AS n_plans,
       min('cust' || o_custkey || '_' || o_orderkey) AS first_example,
       max('cust' || o_custkey || '_' || o_orderkey) AS last_example
FROM orders GROUP BY o_custkey"""

ORACLES["token_normalize"] = _with(LINES) + """
SELECT plan_id, upper(op || ' ' || a1 || ' ' || a2 || ' ' || a3) AS raw, token FROM t"""

ORACLES["decode_actions"] = _with(LINES) + """
SELECT plan_id, step, token, CASE WHEN known THEN op ELSE 'bad_operator_error' END AS operator,
       CASE WHEN known THEN decoded ELSE '' END AS decoded FROM t"""

# Tokens in the order in which plans, in the order of their ids, first show them.
def _dictionary(token: str) -> str:
    return f"""
    dict AS (
      SELECT token, row_number() OVER (ORDER BY first, token) AS token_id FROM (
        SELECT {token} AS token, min((plan_id, section, pos)) AS first FROM (
          SELECT plan_id, 0 AS section, step AS pos, token FROM t
          UNION ALL SELECT plan_id, 1, seq, 'at' || part || supp FROM l WHERE stocked
          UNION ALL SELECT plan_id, 2, seq, 'at' || part || cust FROM l
        ) GROUP BY 1
      )
    )
    """


ORACLES["encode_actions"] = _with(LINES, _dictionary("lower(token)")) + """
SELECT DISTINCT t.decoded, lower(t.token) AS encoded, token_id, t.decoded AS found
FROM t JOIN dict ON dict.token = lower(t.token) WHERE known"""

ORACLES["bracketed_plan"] = _with(LINES) + """
SELECT plan_id, step, CASE WHEN known THEN '(' || op || upper(' ' || a1 || ' ' || a2 || ' ' || a3) || ')' ELSE '(' || token || ')' END AS bracketed
FROM t"""

ORACLES["beautify_facts"] = _with(LINES, TOKENS) + """
SELECT plan_id, section, place, pretty AS fact FROM k WHERE section <> 'actions'"""

ORACLES["split_state_goals"] = _with(LINES, TOKENS) + """
SELECT plan_id, section, place, token FROM k WHERE section <> 'actions'"""

ORACLES["nth_replace"] = """
SELECT doc_id, CASE WHEN len(p) > 2
       THEN p[1] || 'th' || p[2] || 'TH' || array_to_string(p[3:], 'th') ELSE text END AS text
FROM (SELECT doc_id, text, string_split(text, 'th') AS p FROM documents)"""

ORACLES["replay_facts"] = _with(FUNNEL_STEPS, FUNNEL_STATES, recursive=True) + "SELECT * FROM probe"

ORACLES["precondition_failures"] = _with(LINES, STATES, OBJECTS, CLASSES, recursive=True) + """
SELECT plan_id, actions_seen, pre_step AS step FROM cl WHERE class = 'precondition_error'"""

ORACLES["unsatisfied_goals"] = _with(LINES, STATES, recursive=True) + """
SELECT plan_id, fact FROM goal JOIN fin USING (plan_id) WHERE NOT list_contains(facts, fact)"""

ORACLES["validation_classes"] = _with(LINES, STATES, OBJECTS, CLASSES, recursive=True) + """
SELECT plan_id, 'cust' || o_custkey AS problem_id,
       CASE WHEN c_custkey IS NULL THEN 'missing_problem' ELSE class END AS class,
       CASE WHEN c_custkey IS NOT NULL AND class = 'precondition_error' THEN pre_step ELSE 0 END AS step
FROM cl JOIN orders ON o_orderkey = plan_id LEFT JOIN customer ON c_custkey = o_custkey"""

ORACLES["table_domain_classes"] = _with(LINES, STATES, OBJECTS, CLASSES, recursive=True) + """
SELECT plan_id, class, CASE WHEN class = 'precondition_error' THEN pre_step ELSE 0 END AS step FROM cl"""

ORACLES["validation_scores"] = _with(
    FUNNEL_STEPS,
    FUNNEL_STATES,
    """
    fin AS (SELECT plan_id, any_value(user_id) AS user_id, arg_max(bought, step) AS bought FROM fs GROUP BY 1),
    pre AS (SELECT DISTINCT plan_id FROM probe WHERE NOT holds),
    cl AS (SELECT CAST(user_id % 6 AS INTEGER) AS actions_seen,
                  CASE WHEN pre.plan_id IS NOT NULL THEN 'precondition_error'
                       WHEN NOT bought THEN 'unsatisfied_goal_error' ELSE 'valid' END AS class
           FROM fin LEFT JOIN pre USING (plan_id))
    """,
    recursive=True,
) + _score_table("cl")

ORACLES["order_validation_scores"] = _with(LINES, STATES, OBJECTS, CLASSES, recursive=True) + _score_table("cl")

# An order's own problem lists what its lines name, so a name is known there where it is in the customer's problem.
ORACLES["generated_validation_scores"] = _with(
    LINES,
    STATES,
    OBJECTS,
    CLASSES,
    f"""
    made AS (
      SELECT CAST(plan_id % {catalog.GENERATED_BUCKETS} AS INTEGER) AS actions_seen, plan_id IN (SELECT plan_id FROM bad) AS unreadable,
             CASE WHEN plan_id % {catalog.MISSING_SHARE} = 0 THEN 'missing_problem' ELSE class END AS class
      FROM cl
    )
    """,
    recursive=True,
) + _score_table("made", "count(*) FILTER (unreadable)", catalog.GENERATED_BUCKETS)

ORACLES["goal_reached_step"] = _with(LINES, STATES, recursive=True) + """
SELECT st.plan_id, min(st.step) AS step
FROM st LEFT JOIN (SELECT plan_id, list(fact) AS goals FROM goal GROUP BY 1) USING (plan_id)
WHERE goals IS NULL OR list_has_all(st.facts, goals) GROUP BY 1"""

ORACLES["repeated_states"] = _with(LINES, STATES, recursive=True) + """
SELECT plan_id, count(*) AS n_states, count(DISTINCT array_to_string(facts, ' ')) AS n_distinct,
       count(*) - count(DISTINCT array_to_string(facts, ' ')) AS n_revisits FROM st GROUP BY 1"""

ORACLES["applicable_actions"] = _with(LINES, STATES, recursive=True) + """
SELECT DISTINCT l.plan_id, 'SHIP-PART_' || part || '_' || supp || '_' || cust AS action
FROM l JOIN fin USING (plan_id) WHERE list_contains(facts, 'at' || part || supp)
UNION
SELECT DISTINCT l.plan_id, 'SHIP-PART_' || l.part || '_' || o.supp || '_' || l.cust
FROM l JOIN l o ON o.plan_id = l.plan_id JOIN fin ON fin.plan_id = l.plan_id
WHERE list_contains(facts, 'at' || l.part || o.supp)
UNION
SELECT DISTINCT l.plan_id, 'RETURN-PART_' || part || '_' || cust || '_' || supp
FROM l JOIN fin USING (plan_id) WHERE list_contains(facts, 'at' || part || cust)"""

ORACLES["length_filter"] = _with(LINES, SIZES) + f"""
SELECT plan_id, n_actions AS plan_length FROM z WHERE n_actions <= {catalog.MAX_LENGTH}"""

_NAMES = "n AS (SELECT o_orderkey AS plan_id, o_custkey, 'xml-GEN-cust' || o_custkey || '_' || o_orderkey || '.SOL' AS name FROM orders)"

ORACLES["sample_n"] = _with(_NAMES) + f"""
SELECT plan_id, name FROM n ORDER BY {_md5_key('name')}, name LIMIT {catalog.SAMPLE_SIZE}"""

ORACLES["shuffle_facts"] = _with(LINES, TOKENS) + f"""
SELECT plan_id, token AS fact, row_number() OVER (PARTITION BY plan_id ORDER BY
         md5('{catalog.SPLIT_SEED}|xml-GEN-cust' || o_custkey || '_' || plan_id || '.SOL|' || place || '|' || token), place) - 1 AS place
FROM k JOIN orders ON o_orderkey = plan_id WHERE section = 'initial_state'"""

ORACLES["shuffle_shard"] = _with(_NAMES) + f"""
SELECT plan_id, position, CAST(position % {catalog.SHARDS} AS INTEGER) AS shard, hash_shard
FROM (SELECT plan_id, row_number() OVER (ORDER BY {_md5_key('name')}, name) - 1 AS position,
             CAST({_bits('name')} % {catalog.SHARDS} AS INTEGER) AS hash_shard FROM n)"""

_SPLIT = f"""
g AS (SELECT 'cust' || o_custkey AS problem_id, count(*) AS n, count(*) FILTER (n_actions BETWEEN 6 AND 14) AS fit FROM z GROUP BY 1),
g1 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY -ln(({_bits('problem_id')}::DOUBLE + 0.5) / 4503599627370496.0) / n, problem_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
test AS (SELECT problem_id FROM g1 WHERE before < (SELECT floor({catalog.TEST_SIZE} * sum(n)) FROM g)),
rest AS (SELECT * FROM g ANTI JOIN test USING (problem_id)),
g2 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY -ln(({_bits('problem_id', 8)}::DOUBLE + 0.5) / 4503599627370496.0) / fit, problem_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rest WHERE fit > 0),
val AS (SELECT problem_id FROM g2 WHERE before < 20),
split AS (SELECT problem_id, CASE WHEN problem_id IN (SELECT problem_id FROM test) THEN 'test'
                                  WHEN problem_id IN (SELECT problem_id FROM val) THEN 'validation' ELSE 'train' END AS split FROM g)
"""

ORACLES["group_split"] = _with(LINES, SIZES, _SPLIT) + """
SELECT plan_id, problem_id, split FROM z JOIN split ON problem_id = 'cust' || o_custkey"""

ORACLES["threshold_split"] = ORACLES["group_split"]

ORACLES["split_leakage"] = _with(_NAMES, "z AS (SELECT o_orderkey AS plan_id, o_custkey FROM orders)") + f"""
SELECT 'group' AS method, count(DISTINCT o_custkey) AS n_problems, CAST(0 AS BIGINT) AS n_leaking FROM z
UNION ALL
SELECT 'row', count(*), count(*) FILTER (sides > 1) FROM
  (SELECT o_custkey, count(DISTINCT {_bits('name')} % {catalog.SHARDS}) AS sides FROM n GROUP BY 1)"""

ORACLES["token_dictionary"] = _with(LINES, _dictionary("token")) + "SELECT token, token_id FROM dict"

ORACLES["vocab_build"] = _with(
    r"""
    w AS (SELECT unnest(string_split(regexp_replace(regexp_replace(lower(text), '[\t\n\r]', ' ', 'g'),
                 '[\x00-\x1F\x7F]', '', 'g'), ' ')) AS token FROM documents),
    words AS (SELECT token FROM w WHERE token <> '')
    """,
    _vocabulary("words"),
) + "SELECT token, token_id, frequency FROM vocab"

_SPECIAL_IDS = "special(token, id) AS (VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL_TOKENS)) + ")"

ORACLES["sequence_encode"] = _with(LINES, SIZES, TOKENS, SEQUENCES, _dictionary("token"), _SPECIAL_IDS) + f"""
SELECT plan_id, position, CAST(coalesce(id, token_id + {N_SPECIAL - 1}) AS BIGINT) AS token_id
FROM q LEFT JOIN dict USING (token) LEFT JOIN special USING (token)"""

ORACLES["prompt_build"] = _with(LINES, SIZES, TOKENS) + """
SELECT plan_id, CAST(plan_id % 6 AS INTEGER) AS actions_seen,
       row_number() OVER (PARTITION BY plan_id ORDER BY section_no, place) - 1 AS position, token
FROM (
  SELECT plan_id, CASE section WHEN 'initial_state' THEN 0 WHEN 'goals' THEN 1 ELSE 2 END AS section_no, place, token
  FROM k WHERE section <> 'actions' OR place < plan_id % 6
  UNION ALL SELECT plan_id, unnest([1, 2]), -1, unnest(['<|goals|>', '<|actions|>']) FROM z
)"""

ORACLES["truncate_generated"] = _with(LINES, SIZES) + """
SELECT plan_id, step - 1 AS place, token AS action, n_actions AS plan_length FROM t JOIN z USING (plan_id)"""

_PREDICTIONS = """
p AS (SELECT vec_id, vec_id // 16 AS context, CAST(vec_id % 16 AS INTEGER) AS position,
             list_transform(embedding, lambda x: x::DOUBLE) AS logits, label FROM embeddings),
sc AS (SELECT vec_id, context, position, label, unnest(logits) AS score,
              CAST(unnest(range(len(logits))) AS INTEGER) AS token_id FROM p),
pr AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY vec_id) AS probability,
              row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token_id) AS rank FROM sc)
"""

ORACLES["topk_predictions"] = _with(_PREDICTIONS) + f"""
SELECT vec_id, CAST(rank AS INTEGER) AS rank, token_id, round(probability, 6) AS probability
FROM pr WHERE rank <= {catalog.TOP_K}"""

ORACLES["next_action_accuracy"] = _with(_PREDICTIONS) + """
SELECT position, count(*) AS n, count(*) FILTER (token_id = label) AS n_right,
       round(avg(CASE WHEN token_id = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM pr WHERE rank = 1 GROUP BY 1"""

ORACLES["masked_loss"] = _with(_PREDICTIONS) + """,
loss AS (SELECT context // 4 AS batch, -ln(probability) AS loss FROM pr
         WHERE token_id = label AND position <= 12 AND position >= context % 5),
b AS (SELECT batch, sum(loss) AS total, count(*) AS n FROM loss GROUP BY 1)
SELECT CAST(batch % 3 AS INTEGER) AS epoch, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_batches,
       round(sum(total) / sum(n), 6) AS token_loss, round(avg(total / n), 6) AS batch_loss FROM b GROUP BY 1"""

ORACLES["masked_argmax"] = _with(_PREDICTIONS) + f""",
allowed AS (SELECT l_orderkey AS context, l_partkey % (SELECT max(len(embedding)) FROM embeddings) AS token_id, min(l_suppkey) % 10 AS fp
            FROM lineitem GROUP BY 1, 2),
cand AS (
  SELECT sc.context, position, token_id, score,
         token_id = 3 OR NOT EXISTS (SELECT 1 FROM p WHERE p.context = sc.context AND p.label = allowed.fp
                                     AND p.position < sc.position) AS fresh
  FROM sc LEFT JOIN allowed USING (context, token_id) WHERE token_id = 3 OR fp IS NOT NULL
)
SELECT context, position, first(token_id ORDER BY score DESC, token_id) AS greedy_id,
       first(token_id ORDER BY score DESC, token_id) FILTER (fresh) AS token_id,
       (first(token_id ORDER BY score DESC, token_id) FILTER (fresh)) = 3 AS is_end
FROM cand GROUP BY 1, 2"""

ORACLES["masked_successors"] = _with(LINES, STATES, _PREDICTIONS, recursive=True) + f""",
m AS (
  SELECT plan_id, CAST({len(SPECIAL_TOKENS)} + 2 * (l_linenumber - 1) + back AS INTEGER) AS token_id,
         'at' || part || CASE WHEN back = 0 THEN supp ELSE cust END AS need,
         'at' || part || CASE WHEN back = 0 THEN cust ELSE supp END AS gain
  FROM (SELECT l_orderkey AS plan_id, l_linenumber, 'part' || l_partkey AS part, 'supp' || l_suppkey AS supp, 'cust' || o_custkey AS cust
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey), (VALUES (0), (1)) b(back)
),
mv AS (
  SELECT context, position, sc.token_id, score,
         list_sort(list_distinct(list_append(list_filter(facts, lambda f: f <> need), gain))) AS next
  FROM sc JOIN m ON m.plan_id = context AND m.token_id = sc.token_id
  JOIN st ON st.plan_id = context AND st.step = position WHERE list_contains(facts, need)
),
old AS (SELECT DISTINCT context, position, token_id, next FROM mv
        JOIN st ON st.plan_id = context AND st.step <= position AND st.facts = next),
cand AS (
  SELECT mv.*, old.context IS NULL AS fresh FROM mv LEFT JOIN old
  ON old.context = mv.context AND old.position = mv.position AND old.token_id = mv.token_id AND old.next = mv.next
  UNION ALL SELECT context, position, token_id, score, NULL, true FROM sc WHERE token_id = 3
)
SELECT context, position, first(token_id ORDER BY score DESC, token_id) AS greedy_id,
       first(token_id ORDER BY score DESC, token_id) FILTER (fresh) AS token_id,
       (first(token_id ORDER BY score DESC, token_id) FILTER (fresh)) = 3 AS is_end
FROM cand GROUP BY 1, 2"""

ORACLES["step_match"] = _with(FUNNEL_STEPS) + """
SELECT e.user_id, strftime(e.week + INTERVAL 7 DAY, '%Y-%m-%d') AS week, e.step AS position, e.step - 1 AS seen_actions,
       e.op AS pred_action, coalesce(n.op, '') AS real_action, e.op = coalesce(n.op, '') AS is_match
FROM e LEFT JOIN e n ON n.user_id = e.user_id AND n.week = e.week + INTERVAL 7 DAY AND n.step = e.step"""

_ANALYSED = _with(LINES, SIZES, CORPUS_TOKENS, _vocabulary("tok", "(SELECT max(len(embedding)) FROM embeddings)"), _PREDICTIONS) + f""",
texts AS (SELECT token_id, regexp_replace(regexp_replace(token, '^(SHIP|RETURN)PART(PART)', '\\1-PART_\\2'),
                 '(PART|SUPP|CUST)(\\d+)(SUPP|CUST)(\\d+)(SUPP|CUST)(\\d+)$', '\\1\\2_\\3\\4_\\5\\6') AS text FROM vocab),
named AS (SELECT token_id, CASE WHEN text LIKE '%-PART_%'
                 THEN split_part(text, '_', 1) || '_' || lower(substr(text, strpos(text, '_') + 1)) ELSE text END AS text FROM texts),
steps AS (
  SELECT context AS example, position, CASE WHEN z.plan_id IS NULL THEN 0 ELSE context % 6 END + position AS step,
         max(CASE WHEN rank = 1 THEN text END) AS generated,
         string_agg(text || ':' || CAST(CAST(round(probability * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS top
  FROM pr JOIN named USING (token_id) LEFT JOIN z ON z.plan_id = context WHERE rank <= {catalog.TOP_K} GROUP BY 1, 2, 3
),
analysed AS (
  SELECT example, position, z.plan_id IS NOT NULL AS has_example,
         coalesce('xml-GEN-cust' || z.o_custkey || '_' || example || '.SOL', '') AS example_name, coalesce('cust' || z.o_custkey, '') AS problem_id,
         coalesce(n_actions, 0) AS real_plan_length, count(*) FILTER (generated <> '<|endofplan|>') OVER (PARTITION BY example) AS generated_plan_length,
         steps.step AS actions_seen,
         CASE WHEN steps.step = n_actions THEN '<|endofplan|>' WHEN known THEN decoded ELSE coalesce(token, '') END AS real_action,
         generated AS generated_action, top AS top_k
  FROM steps LEFT JOIN z ON z.plan_id = example LEFT JOIN t ON t.plan_id = example AND t.step = steps.step + 1
)
"""

ORACLES["error_analysis"] = _ANALYSED + "SELECT * FROM analysed"

ORACLES["error_records"] = _ANALYSED + f"""
SELECT example, part, parts, has_example, example_name, problem_id, real_plan_length, generated_plan_length,
       string_agg(actions_seen || '|' || real_action || '|' || generated_action || '|' || top_k, ';' ORDER BY position) AS predictions
FROM (SELECT *, CAST(position // {catalog.PREDICTIONS_PER_RECORD} AS BIGINT) AS part,
             CAST(max(position) OVER (PARTITION BY example) // {catalog.PREDICTIONS_PER_RECORD} + 1 AS BIGINT) AS parts FROM analysed)
GROUP BY ALL"""

ORACLES["enrich_static_facts"] = _with(LINES, SIZES, TOKENS) + """
SELECT plan_id, place, token AS fact FROM k WHERE section = 'initial_state'
UNION ALL
SELECT plan_id, n_initial_state + row_number() OVER (PARTITION BY plan_id ORDER BY substr(md5(fact), 1, 3), fact) - 1, fact
FROM (
  SELECT plan_id, n_initial_state,
         unnest(['innationcust' || c_custkey || 'nation' || n_nationkey, 'inregionnation' || n_nationkey || 'region' || n_regionkey]) AS fact
  FROM z JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

_FILE = "'cust' || o_custkey || '_' || plan_id || '.pddl'"
# The files of orders, whose texts have a row per thousands of facts, and those of their lines, named by their first steps.
_LINE_FILE = "'cust' || o_custkey || '_' || plan_id || '_' || seq || '.pddl'"
_FILES = """
x AS (
  SELECT o_orderkey AS plan_id, orders.o_custkey, coalesce(seq, 1) AS seq, CASE WHEN stocked THEN 'at' || part || supp END AS fact,
         'at' || part || cust AS goal
  FROM orders LEFT JOIN l ON l.plan_id = o_orderkey
)
"""
_PIECES = f"""
w AS (
  SELECT plan_id, place // {TEXT_FACTS} AS piece, string_agg(token, ' ' ORDER BY place) FILTER (section = 'initial_state') AS initial_state,
         string_agg(token, ' ' ORDER BY place) FILTER (section = 'goals') AS goals FROM k WHERE section <> 'actions' GROUP BY 1, 2
)
"""
ORACLES["problem_parse"] = _with(LINES, SIZES, TOKENS, _FILES, _PIECES) + f"""
SELECT {_FILE} AS name, {_FILE} AS pddl_problem_file, CAST(coalesce(piece, 0) AS BIGINT) AS piece, coalesce(initial_state, '') AS initial_state,
       coalesce(goals, '') AS goals, '' AS actions, n_initial_state AS len_initial_state, n_goals AS len_goals,
       CAST(0 AS BIGINT) AS len_plan, n_initial_state + n_goals + 2 AS actions_idx, CAST(-1 AS BIGINT) AS eop_idx
FROM z LEFT JOIN w USING (plan_id)
UNION ALL
SELECT {_LINE_FILE}, {_LINE_FILE}, CAST(0 AS BIGINT), coalesce(fact, ''), coalesce(goal, ''), '', CAST(fact IS NOT NULL AS BIGINT),
       CAST(goal IS NOT NULL AS BIGINT), CAST(0 AS BIGINT), CAST(fact IS NOT NULL AS BIGINT) + CAST(goal IS NOT NULL AS BIGINT) + 2,
       CAST(-1 AS BIGINT) FROM x"""

ORACLES["problem_facts"] = _with(LINES, SIZES, TOKENS) + f"""
SELECT {_FILE} AS name, CASE section WHEN 'goals' THEN 'goal' ELSE 'init' END AS section, place, token AS fact
FROM k JOIN z USING (plan_id) WHERE section <> 'actions'"""

ORACLES["problem_objects"] = _with(LINES) + f"""
SELECT DISTINCT {_FILE} AS name, part AS object, 'part' AS type FROM l JOIN part p ON part = 'part' || p_partkey WHERE p_size <> 50
UNION ALL SELECT DISTINCT {_FILE}, supp, 'supplier' FROM l JOIN supplier ON supp = 'supp' || s_suppkey
UNION ALL SELECT 'cust' || o_custkey || '_' || o_orderkey || '.pddl', 'cust' || o_custkey, 'customer' FROM orders JOIN customer ON c_custkey = o_custkey"""

ORACLES["static_fact_extract"] = _with(LINES, _FILES) + f"""
SELECT name, 'in-nation cust' || o_custkey || ' nation' || n_nationkey AS fact
FROM (SELECT DISTINCT {_FILE} AS name, o_custkey FROM x UNION ALL SELECT {_LINE_FILE}, o_custkey FROM x)
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"""

_LOG = "'xml-GEN-cust' || o_custkey || '_' || plan_id || '.SOL'"
ORACLES["plan_log_parse"] = _with(LINES) + f"""
SELECT {_LOG} AS plan_name, 'action' AS kind, step, op || upper(' ' || a1 || ' ' || a2 || ' ' || a3) AS text, CAST(step AS VARCHAR) AS id,
       CASE WHEN step > 1 THEN CAST(step - 1 AS VARCHAR) ELSE '' END AS predecessor, 'at ' || a1 || ' ' || a2 AS precondition,
       'at ' || a1 || ' ' || a3 AS positive_effects, 'at ' || a1 || ' ' || a2 AS negative_effects FROM t
UNION ALL
SELECT {_LOG}, 'initial', 0, 'at ' || part || ' ' || supp, '', '', '', '', '' FROM l WHERE stocked
UNION ALL
SELECT {_LOG}, 'goals', 0, 'at ' || part || ' ' || cust, '', '', '', '', '' FROM l"""

# The states that the logs' own effects make, those of unknown operators too. Goals have step 0.
ORACLES["log_effect_replay"] = _with(
    LINES,
    """
    i0 AS (
      SELECT plan_id, o_custkey, coalesce(list_distinct(list('at ' || part || ' ' || supp) FILTER (stocked)), []) AS facts
      FROM l GROUP BY 1, 2
    ),
    st AS (
      SELECT plan_id, o_custkey, CAST(0 AS BIGINT) AS step, facts, '' AS asked, false AS holds FROM i0
      UNION ALL
      SELECT st.plan_id, st.o_custkey, t.step,
             list_distinct(list_append(list_filter(st.facts, lambda f: f <> 'at ' || t.a1 || ' ' || t.a2), 'at ' || t.a1 || ' ' || t.a3)),
             'at ' || t.a1 || ' ' || t.a2, list_contains(st.facts, 'at ' || t.a1 || ' ' || t.a2)
      FROM st JOIN t ON t.plan_id = st.plan_id AND t.step = st.step + 1
    ),
    fin AS (SELECT plan_id, arg_max(facts, step) AS facts FROM st GROUP BY plan_id)
    """,
    recursive=True,
) + f"""
SELECT {_LOG} AS plan_id, step, asked AS fact, holds FROM st WHERE step > 0
UNION ALL
SELECT DISTINCT {_LOG.replace('plan_id', 'l.plan_id')}, CAST(0 AS BIGINT), 'at ' || part || ' ' || cust, list_contains(facts, 'at ' || part || ' ' || cust)
FROM l JOIN fin USING (plan_id)"""
