"""Carrier texts: domain wording around the synthetic documents, as SQL that Spark and DuckDB read alike.

The documents hold none of the wording that the extractors look for, so each query puts some in front of the whole text,
chosen by doc_id so that every branch is met.
"""

from __future__ import annotations

TEXT = "coalesce(text, '')"

ELIGIBILITY = f"""concat(CASE doc_id % 6
  WHEN 0 THEN concat('Inclusion criteria: patients aged ', 18 + doc_id % 5, ' to ', 60 + doc_id % 20, ' years; ')
  WHEN 1 THEN concat('Eligible adults were at least ', 18 + doc_id % 5, ' years old. ')
  WHEN 2 THEN concat('Criteria: age <= ', 60 + doc_id % 20, ' years. ')
  WHEN 3 THEN 'The dosage was fixed; no limits. '
  WHEN 4 THEN concat('Inclusion: up to ', 100 + doc_id % 50, ' years. Recruited subjects ', 20 + doc_id % 7, ' years or older. ')
  ELSE '' END, CASE WHEN doc_id % 6 = 5 THEN '' ELSE {TEXT} END)"""

METHODS = """CASE doc_id % 4
  WHEN 0 THEN concat('Ages 20 to ', 65 + doc_id % 11, ' years were seen. ')
  WHEN 1 THEN concat('Inclusion: aged between ', 16 + doc_id % 4, ' and ', 70 + doc_id % 9, ' years. ')
  WHEN 2 THEN 'Subjects aged 65 to 18 years enrolled.'
  ELSE '' END"""

TITLE = """CASE doc_id % 7
  WHEN 0 THEN 'A randomized placebo.controlled trial' WHEN 1 THEN 'A retrospective cohort study'
  WHEN 2 THEN 'Outcomes after prostatectomy' WHEN 3 THEN 'Placenta and prostate cancer'
  WHEN 4 THEN 'Phase 2 interventional protocol' WHEN 5 THEN 'HER2-positive disease in women only' ELSE 'Case report' END"""

ABSTRACT = f"""concat(CASE doc_id % 5
  WHEN 0 THEN 'This double-blind crossover study of placebo. ' WHEN 1 THEN 'We ran a cross-sectional study with a registry. '
  WHEN 2 THEN 'Registered as NCT01234567, all patients were male. ' WHEN 3 THEN 'A meta-analysis and systematic review. '
  ELSE '' END, {TEXT})"""

KEYWORDS = "CASE doc_id % 3 WHEN 0 THEN array('alpha', 'beta two') WHEN 1 THEN array('gamma') ELSE array() END"

PREDICTED = """CASE doc_id % 5 WHEN 0 THEN concat(18 + doc_id % 9, ' Years') WHEN 1 THEN 'Not Specified' WHEN 2 THEN '18 to 65'
  WHEN 3 THEN concat(60 + doc_id % 3, '.5 years and ', doc_id % 7) ELSE '' END"""
GOLD = """CASE doc_id % 4 WHEN 0 THEN '18 Years' WHEN 1 THEN concat(18 + doc_id % 9, ' Years') WHEN 2 THEN 'Not Specified' ELSE '65 and 18' END"""

MODEL_OUTPUT = """CASE doc_id % 5
  WHEN 0 THEN concat('["Disease ', doc_id % 13, '", " Asthma "]') WHEN 1 THEN concat('{"conditions": ["Stroke", "Type ', doc_id % 3, '"]}')
  WHEN 2 THEN '["a","b","c","d","e","f","g","h"]' WHEN 3 THEN '["Alzheimer''s Disease"]' ELSE '[]' END"""

#: Words of a whole text that the derived taxonomy and tags know.
PLAIN = f"regexp_extract_all(lower({TEXT}), '[a-z][a-z][a-z]+'{{0}})"

# A taxonomy over the documents' own words: nouns by their first and last letters, verbs by their first.
#: The senses of word w, (synset, rank) in order; null where w has none.
SENSES = (
    ("concat('p', left(w, 5))", 1),
    ("CASE WHEN length(w) >= 6 THEN concat('s', right(w, 4)) END", 2),
    ("CASE WHEN w LIKE '%ed' OR w LIKE '%ing' OR w LIKE '%ment' THEN concat('v', left(w, 4)) END", 3),
)
#: Parents of synset s, two at most; the roots are n and v.
PARENTS = (
    """CASE WHEN s LIKE 'p%' THEN CASE length(s) WHEN 2 THEN 'n' WHEN 4 THEN left(s, 2) ELSE left(s, 4) END
        WHEN s LIKE 's%' THEN CASE length(s) WHEN 5 THEN concat('s', right(s, 2)) ELSE 'n' END
        WHEN s LIKE 'v%' AND length(s) > 1 THEN CASE length(s) WHEN 3 THEN 'v' ELSE left(s, 3) END END""",
    "CASE WHEN s LIKE 's%' AND length(s) = 5 THEN concat('p', substring(s, 2, 1)) END",
)
#: Steps from a sense to its root.
LEVELS = 3
KIND = "CASE WHEN s LIKE 'v%' THEN 'v' ELSE 'n' END"

#: The tag of word x after word y, null at the start: by length, and for words of six or seven letters by the word before.
TAG = """CASE WHEN length(x) <= 3 THEN 'DT' WHEN length(x) = 4 THEN 'IN' WHEN length(x) = 5 THEN 'JJ' WHEN length(x) >= 8 THEN 'NN'
    WHEN length(y) <= 3 THEN 'VBD' ELSE 'NNS' END"""
