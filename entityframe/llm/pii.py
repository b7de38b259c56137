"""Format-preserving pseudonyms for personal data in texts, DataFrame functions only.

A found value is taken apart into cells, each with its own radix; a keyed Feistel network over the cells (addition cell
by cell modulo the radix) permutes all values of the format, and the cells are put back. Valid values stay valid (Luhn
digits, octets, calendar dates) and equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table

ROUNDS = 10  # even, so that halves of unequal length return to their places
#: Kinds in the order in which they are tried. Patterns don't back up over long runs.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    "ipv4": r"(?<![A-Za-z0-9.])(?:\d{1,3}+\.){3}\d{1,3}+(?!\.?\d)(?![A-Za-z])",
    "date": r"(?<![A-Za-z0-9-])\d{4}-\d{2}-\d{2}(?![0-9-])",
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "card": r"(?<![A-Za-z0-9-])(?:\d{13,19}+|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![A-Za-z0-9]|-\d)",
    "phone": r"(?<![A-Za-z0-9(+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![0-9-])",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|api[_-]?key|secret|token)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,}+",
}
ANY = "|".join(PATTERNS.values())
#: All dates of four-digit years: the first, and two factors of their number.
FIRST_DAY, DAYS = "0001-01-01", (5151, 709)
#: Letters and digits that are permuted together; longer values go in groups of GROUP to 2 * GROUP - 1, so that cost is linear.
TOGETHER, GROUP = 255, 32
#: Characters with a value of their own: ASCII digits and letters, and all beyond ASCII, which move within 32 code points.
#: A secret with fewer of them has its punctuation permuted too.
STRONG, ANY_MARK, ENOUGH = r"[0-9A-Za-z\x{80}-\x{10FFFF}]", r"[^\x00-\x20\x7F]", 6
MARKS = "!#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _permuted(kind: str, cells: str, radices: str, tag: str = "") -> str:
    """SQL of the permuted cells: `cells` and `radices` are SQL arrays of whole numbers of one length; one cell is shifted.

    `tag`: SQL of the name of the permutation, if it isn't the kind. The key is in the column __key.
    """
    number = "cast(conv(substr(sha2(concat_ws('|', __key, z.t, {}), 256), 1, 14), 16, 10) AS bigint)"
    add = f"transform(s.l, (a, j) -> (a + {number.format("i, j, array_join(s.m, ','), array_join(s.r, ',')")}) % s.m[j])"
    half = "cast(size(z.c) / 2 AS int)"
    left, right = (lambda x: f"slice({x}, 1, {half})"), (lambda x: f"slice({x}, {half} + 1, size(z.c))")
    start = f"named_struct('l', {left('z.c')}, 'r', {right('z.c')}, 'm', {left('z.m')}, 'n', {right('z.m')})"
    step = f"(s, i) -> named_struct('l', s.r, 'r', {add}, 'm', s.n, 'n', s.m)"
    network = f"aggregate(sequence(1, {ROUNDS}), {start}, {step}, s -> concat(s.l, s.r))"
    one = f"array((z.c[0] + {number.format("'one'")}) % z.m[0])"
    # an array of one binds the cells to a name
    return f"transform(array(named_struct('c', {cells}, 'm', {radices}, 't', {tag or repr(kind)})), z -> IF(size(z.c) = 1, {one}, {network}))[0]"


def _refilled(value: str, cell: str, cells: str) -> str:
    """SQL of `value` with the parts that match `cell` replaced by the strings of `cells` in order."""
    return f"array_join(zip_with(split({value}, {_sql(cell)}, -1), {cells}, (a, b) -> concat(a, coalesce(b, ''))), '')"


def _letters(kind: str, value: str, marks: bool = False) -> str:
    """SQL of `value` with each STRONG character permuted within its class; lower-case hexadecimals stay such.

    With `marks`, a value of less than ENOUGH of them has its punctuation permuted too; their number never changes, so
    this is a permutation still. Groups of a long value have permutations of their own, by their place and the length.
    """
    strong, every = (f"regexp_extract_all({value}, {_sql(p)}, 0)" for p in (STRONG, ANY_MARK))
    weak = f"size({strong}) < {ENOUGH}" if marks else "false"
    own = f"IF({weak}, {every}, {strong})"
    bound = f"named_struct('o', {own}, 'k', {weak}, 'h', {value} RLIKE '^[0-9a-f]{{8,}}$', 'n', cast(IF(size({own}) > {TOGETHER}, size({own}) div {GROUP}, 1) AS int))"

    def by_class(what: int, code: str, char: str, rest: str) -> str:
        """CASE over the classes of a character: its cell, its radix, or the character of the cell d."""
        at = f"instr({_sql(MARKS)}, {char})"
        classes = [
            (f"{code} BETWEEN 48 AND 57", f"{code} - 48", "10", "chr(d + 48)"),
            (f"{code} BETWEEN 65 AND 90", f"{code} - 65", "26", "chr(d + 65)"),
            (f"{code} BETWEEN 97 AND 122", f"{code} - 97", "26", "chr(d + 97)"),
            (f"{code} > 127", f"{code} % 32", "32", f"decode(unhex(lpad(hex({code} - {code} % 32 + d), 8, '0')), 'UTF-32')"),
            (f"{at} > 0", f"{at} - 1", str(len(MARKS)), f"substr({_sql(MARKS)}, cast(d AS int) + 1, 1)"),
        ]
        return "CASE " + " ".join(f"WHEN {c[0]} THEN {c[what]}" for c in classes) + f" ELSE {rest} END"

    group = f"slice(w.o, k * {GROUP} + 1, IF(k < w.n - 1, {GROUP}, size(w.o)))"  # the last takes the rest
    cells = f"transform({group}, c -> cast(IF(w.h, cast(conv(c, 16, 10) AS int), {by_class(1, 'ascii(c)', 'c', '0')}) AS bigint))"
    radices = f"transform({group}, c -> cast(IF(w.h, 16, {by_class(2, 'ascii(c)', 'c', '1')}) AS bigint))"
    tag = f"IF(w.n = 1, '{kind}', concat('{kind}/', k, '/', size(w.o)))"
    moved = f"flatten(transform(sequence(0, w.n - 1), k -> {_permuted(kind, cells, radices, tag)}))"
    back = f"zip_with({moved}, w.o, (d, c) -> IF(w.h, lower(hex(d)), {by_class(3, 'ascii(c)', 'c', 'c')}))"
    filled = f"IF(w.k, {_refilled(value, ANY_MARK, back)}, {_refilled(value, STRONG, back)})"
    return f"transform(array({bound}), w -> IF(size(w.o) = 0, {value}, {filled}))[0]"


def _luhn(digits: str, even: bool) -> str:
    """SQL of the Luhn sum of an array of digits, the last of which is doubled if not `even`."""
    return f"aggregate(transform(reverse({digits}), (d, j) -> IF(j % 2 = {1 if even else 0}, cast(d AS int) * 2 - IF(cast(d AS int) > 4, 9, 0), cast(d AS int))), 0, (a, x) -> a + x)"


def kind_of(value: str) -> str:
    """SQL of the kind of a match, null if it isn't valid in its format."""
    all_digits = f"regexp_extract_all({value}, '[0-9]', 0)"
    valid = {
        "ipv4": f"exists(split({value}, '[.]'), x -> cast(x AS int) > 255) = false",
        "date": f"try_cast({value} AS date) IS NOT NULL AND datediff(try_cast({value} AS date), date'{FIRST_DAY}') BETWEEN 0 AND {DAYS[0] * DAYS[1] - 1}",
        "ssn": f"{value} RLIKE '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}$'",
        "card": f"{_luhn(all_digits, True)} % 10 = 0 AND {value} RLIKE '[1-9]'",
    }
    whens = []
    for kind, pattern in PATTERNS.items():
        whens.append(f"WHEN {value} RLIKE {_sql(f'^(?:{pattern})$')} THEN " + (f"IF({valid[kind]}, '{kind}', NULL)" if kind in valid else f"'{kind}'"))
    return "CASE " + " ".join(whens) + " END"


def pseudonym(value: str, kind: str) -> str:
    """SQL of the pseudonym of a match `value` of a kind; the key is in the column __key."""
    digits = f"regexp_extract_all({value}, '[0-9]', 0)"
    n = f"size({digits})"
    # all digits but the check digit; all zeros aren't a card, so what comes to them goes on
    body, tens = f"transform(slice({digits}, 1, {n} - 1), d -> cast(d AS bigint))", f"array_repeat(10L, {n} - 1)"
    card = f"transform(array({_permuted('card', body, tens)}), p -> IF(exists(p, d -> d > 0), p, {_permuted('card', 'p', tens)}))[0]"
    card = f"transform({card}, d -> cast(d AS string))"
    check = f"array_join(transform(array({card}), p -> {_refilled(value, '[0-9]', 'concat(p, array(cast((10 - ' + _luhn('p', False) + ' % 10) % 10 AS string)))')}), '')"
    octets = f"transform(split({value}, '[.]'), x -> cast(x AS bigint))"
    ip = _permuted("ipv4", octets, "array(256L, 256L, 256L, 256L)")
    day = f"cast(datediff(cast({value} AS date), date'{FIRST_DAY}') AS bigint)"
    moved = _permuted("date", f"array(cast(floor({day} / {DAYS[1]}) AS bigint), {day} % {DAYS[1]})", f"array({DAYS[0]}L, {DAYS[1]}L)")
    area = f"cast(substr({value}, 1, 3) AS bigint)"
    ssn = _permuted("ssn", f"array({area} - IF({area} > 666, 2, 1), cast(substr({value}, 5, 2) AS bigint) - 1, cast(substr({value}, 8, 4) AS bigint) - 1)", "array(898L, 99L, 9999L)")
    phone_cells = f"slice({digits}, {n} - 9, 10)"
    low = "IF(j = 0 OR j = 3, 2, 0)"
    # area and exchange begin with 2 to 9 where the found ones do
    fits = f"{phone_cells}[0] > '1' AND {phone_cells}[3] > '1'"
    phone = f"transform({_permuted('phone', f'transform({phone_cells}, (d, j) -> cast(d AS bigint) - IF({fits}, {low}, 0))', f'transform({phone_cells}, (d, j) -> cast(10 - IF({fits}, {low}, 0) AS bigint))')}, (d, j) -> cast(d + IF({fits}, {low}, 0) AS string))"
    local, tld = f"regexp_extract({value}, '^(.*)[.]', 1)", f"regexp_extract({value}, '([.][^.]*)$', 1)"
    label = f"regexp_extract({value}, '^([^=:]*[=:][ \\\\s]*[\"\\']?)', 1)"
    body = f"substr({value}, length({label}) + 1)"
    return f"""CASE {kind}
      WHEN 'email' THEN concat({_letters('email', local)}, {tld})
      WHEN 'ipv4' THEN array_join(transform({ip}, x -> cast(x AS string)), '.')
      WHEN 'date' THEN array_join(transform(array({moved}), p -> cast(date_add(date'{FIRST_DAY}', cast(p[0] * {DAYS[1]} + p[1] AS int)) AS string)), '')
      WHEN 'ssn' THEN array_join(transform(array({ssn}), p -> concat(lpad(cast(p[0] + IF(p[0] >= 665, 2, 1) AS string), 3, '0'), '-', lpad(cast(p[1] + 1 AS string), 2, '0'), '-', lpad(cast(p[2] + 1 AS string), 4, '0'))), '')
      WHEN 'card' THEN {check}
      WHEN 'phone' THEN {_refilled(value, '[0-9]', f"concat(slice({digits}, 1, {n} - 10), {phone})")}
      WHEN 'key' THEN concat('AKIA', {_letters('key', f"substr({value}, 5)")})
      WHEN 'secret' THEN concat({label}, {_letters('secret', body, True)})
      ELSE {value} END"""


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of `docs` with `text` pseudonymised, `n_pii` values replaced and `pii_kinds`, their kinds in order.

    Null texts stay null, with no values. Matches that aren't valid in their format are left as they are. Columns of
    `docs` named n_pii or pii_kinds are replaced. Repeated rows are treated alike. The key is read from a table of one
    row while the query runs, so no plan shows it.
    """
    t = F.col(text)
    docs = docs.withColumn("__key", docs.sparkSession.createDataFrame([(key,)], "k string").scalar())
    # a text without any of these has no match; a key may hold letters only
    at_all = F.coalesce(t.rlike(r"[@=:]|\d|AKIA"), F.lit(False))
    rows = docs.withColumn("__found", F.when(at_all, F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("__found", F.when(F.size("__found") > 0, F.expr(f"transform(__found, v -> named_struct('v', v, 'k', {kind_of('v')}))")))
    rows = rows.withColumn("__new", F.expr(f"transform(__found, x -> {pseudonym('x.v', 'x.k')})"))
    rows = rows.withColumn(text, F.when(F.col("__new").isNotNull(), _woven(t)).otherwise(t))
    kinds = F.coalesce(F.expr("transform(filter(__found, x -> x.k IS NOT NULL), x -> x.k)"), F.array().cast("array<string>"))
    return rows.withColumn("pii_kinds", kinds).withColumn("n_pii", F.size("pii_kinds").cast("long")).drop("__found", "__new", "__key")


def _woven(t: Column) -> Column:
    between = F.split(t, ANY, -1)
    return F.array_join(F.zip_with(between, F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, key="example key; a deployment passes its own")
