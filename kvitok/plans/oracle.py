"""The same queries as plain SQL for DuckDB, written apart from the Spark plans.

The mail queries are checked against what the bills were written from, so no SQL
here reads MIME, HTML or bill text.
"""

from __future__ import annotations

# Raw service names by remainder, as in ``sources.sample``.
_RAW = (
    "['ХВС КПУ','ХВС пр.д.','ГВС КПУ','ГВС пр. д.','Водоотв.','Отопление','Сод.жил.',"
    "'кап. ремонт','ТКО','Запирающее устр.','Обсл. шлагбаумов','Домофон']"
    "[CAST({0} % 12 AS INT) + 1]"
)

# Canonical name of each raw name.
_CANONICAL = """CASE
  WHEN {0} LIKE 'ХВС%' THEN 'ХВС' WHEN {0} LIKE 'ГВС%' THEN 'ГВС'
  WHEN {0} = 'Водоотв.' THEN 'Водоотведение' WHEN {0} = 'Сод.жил.' THEN 'Содержание жилья'
  WHEN {0} = 'кап. ремонт' THEN 'Капитальный ремонт'
  WHEN {0} = 'Запирающее устр.' THEN 'Запирающее устройство'
  WHEN {0} = 'Обсл. шлагбаумов' THEN 'Шлагбаум' ELSE {0} END"""

# Name a text line gets for each raw name.
_TEXT_NAME = """CASE
  WHEN {0} LIKE 'ХВС%' THEN 'ХВС КПУ' WHEN {0} LIKE 'ГВС%' THEN 'ГВС КПУ'
  WHEN {0} = 'Водоотв.' THEN 'Водоотведение' WHEN {0} = 'Сод.жил.' THEN 'Содержание жилья'
  WHEN {0} = 'кап. ремонт' THEN 'Капремонт'
  WHEN {0} = 'Запирающее устр.' THEN 'Запирающее устройство'
  WHEN {0} = 'Обсл. шлагбаумов' THEN 'Шлагбаум' ELSE {0} END"""

_ACCOUNT = "lpad(CAST({0} AS VARCHAR), greatest(10, length(CAST({0} AS VARCHAR)))::INTEGER, '0')"

_TABLES = f"""
addresses AS (
  SELECT {_ACCOUNT.format("c_custkey")} AS account_number, n_name || ', ' || c_mktsegment AS address
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
heads AS (
  SELECT o_orderkey, {_ACCOUNT.format("o_custkey")} AS account_number,
    CAST(year(o_orderdate) AS INT) AS "year", CAST(month(o_orderdate) AS INT) AS "month",
    o_orderdate, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,2)) AS total_price
  FROM orders),
bills AS (SELECT * FROM heads JOIN addresses USING (account_number)),
lines AS (
  SELECT account_number, "year", "month", {_RAW.format("l_partkey")} AS raw_service,
    CAST(l_quantity AS DECIMAL(18,3)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_due,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
  FROM lineitem JOIN heads ON l_orderkey = o_orderkey),
named AS (SELECT *, {_CANONICAL.format("raw_service")} AS service FROM lines),
charges AS (
  SELECT * FROM named QUALIFY row_number() OVER (
    PARTITION BY account_number, "year", "month", service
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC,
      quantity DESC, amount_due DESC, l_shipdate DESC) = 1),
months AS (
  SELECT address, "year", "month", service, sum(quantity) AS quantity, sum(amount_due) AS amount_due,
    "year" || '-' || lpad(CAST("month" AS VARCHAR), 2, '0') AS ym
  FROM charges JOIN addresses USING (account_number) GROUP BY ALL),
charged AS (SELECT DISTINCT address, "year", "month" FROM months),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY "year", "month") AS k FROM charged),
analyses AS (
  SELECT address, "year", "month", 'Счёт ' || account_number AS prompt,
    '### Итог' || chr(10) || '**' || account_number || '** & *' || o_orderpriority || '*' || chr(10)
      || '- сумма ' || CAST(total_price AS VARCHAR) AS response,
    'model-' || o_orderstatus AS model, CAST(floor(total_price) AS INT) AS tokens_used,
    o_orderdate AS created_at, o_orderkey AS seq
  FROM bills WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'),
latest AS (
  SELECT * FROM analyses QUALIFY row_number() OVER (
    PARTITION BY address, "year", "month" ORDER BY created_at DESC, seq DESC) = 1),
grid AS (
  SELECT s.address, p.label, s.service, coalesce(m.amount_due, 0) AS amount,
    coalesce(m.quantity, 0) AS quantity
  FROM (SELECT DISTINCT address, service FROM months
        WHERE "year" * 12 + "month" BETWEEN 1995 * 12 + 3 AND 2001 * 12 + 6) s
  CROSS JOIN (SELECT DISTINCT "year" || '-' || lpad(CAST("month" AS VARCHAR), 2, '0') AS label FROM heads
        WHERE "year" * 12 + "month" BETWEEN 1995 * 12 + 3 AND 2001 * 12 + 6) p
  LEFT JOIN months m ON m.address = s.address AND m.service = s.service AND m.ym = p.label)
"""

_MONEY = "CAST(CAST({0} AS DECIMAL(18,2)) AS VARCHAR)"
_QUANTITY = "CAST(CAST({0} AS DECIMAL(18,3)) AS VARCHAR)"

# What each sample message was written from, and what must come out of it.
_MAIL = f"""
mails AS (
  SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), greatest(12, length(CAST(l_orderkey AS VARCHAR)))::INTEGER, '0'),
      lpad(CAST(l_linenumber AS VARCHAR), greatest(2, length(CAST(l_linenumber AS VARCHAR)))::INTEGER, '0'), lpad(CAST(l_partkey AS VARCHAR), greatest(12, length(CAST(l_partkey AS VARCHAR)))::INTEGER, '0'),
      lpad(CAST(l_suppkey AS VARCHAR), greatest(12, length(CAST(l_suppkey AS VARCHAR)))::INTEGER, '0'), lpad({_QUANTITY.format("l_quantity")}, greatest(12, length({_QUANTITY.format("l_quantity")}))::INTEGER, '0'),
      lpad({_MONEY.format("l_extendedprice")}, greatest(16, length({_MONEY.format("l_extendedprice")}))::INTEGER, '0')) AS msg_id,
    l_shipdate AS received_at, l_linenumber AS kind, l_returnflag AS flag,
    account_number, address, "year", "month",
    NOT (l_linestatus = 'F' AND l_linenumber IN (2, 4)) AS accepted,
    {_RAW.format("l_partkey")} AS raw_1, {_RAW.format("l_suppkey")} AS raw_2,
    CAST(l_quantity AS DECIMAL(18,3)) AS quantity_1, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_1,
    CAST(l_linenumber + 0.25 AS DECIMAL(18,3)) AS quantity_2, CAST(l_quantity AS DECIMAL(18,2)) AS amount_2,
    1 + l_partkey % 4 AS rooms, 1 + l_suppkey % 5 AS residents,
    30.5 + l_partkey % 60 AS total_area, 10.2 + l_suppkey % 20 AS living_area,
    strftime(l_shipdate, '%d.%m.%Y') AS paid_on
  FROM lineitem JOIN bills ON l_orderkey = o_orderkey),
known AS (
  SELECT *, CAST(raw_1 <> 'Домофон' AS INT) + CAST(raw_2 <> 'Домофон' AS INT) AS n FROM mails),
outcome AS (
  SELECT *, CASE
      WHEN kind = 3 AND flag = 'A' THEN 'bad_area'
      WHEN kind = 7 AND flag = 'N' THEN 'bad_total'
      WHEN kind = 7 AND flag = 'A' THEN 'bad_month'
      WHEN kind = 6 OR (kind IN (3, 4) AND n = 0) THEN 'no_bill' END AS reason,
    CASE WHEN kind IN (1, 3, 4) AND n > 0 THEN 'html' ELSE 'text' END AS source
  FROM known),
mail_lines AS (
  SELECT *, 0 AS line_no, raw_1 AS raw, quantity_1 AS quantity, amount_1 AS amount FROM outcome
  WHERE raw_1 <> 'Домофон'
  UNION ALL
  SELECT *, 1 AS line_no, raw_2, quantity_2, amount_2 FROM outcome WHERE raw_2 <> 'Домофон'),
mail_named AS (
  SELECT *, CASE WHEN source = 'html' THEN {_CANONICAL.format("raw")}
    WHEN raw = 'кап. ремонт' THEN 'Капремонт' ELSE {_CANONICAL.format("raw")} END AS service
  FROM mail_lines WHERE accepted AND reason IS NULL),
mail_charges AS (
  SELECT * FROM mail_named QUALIFY row_number() OVER (
    PARTITION BY account_number, "year", "month", service
    ORDER BY received_at DESC, msg_id DESC, line_no DESC) = 1)
"""

_WRITTEN = f"""
texts AS (
  SELECT *, CASE kind WHEN 6 THEN '' WHEN 5 THEN 'код плательщика: ' || account_number
      ELSE 'ФЛС № ' || account_number END || ' АДРЕС: ' || address
    || CASE WHEN kind = 2 THEN ' на ' || "year" || '-' || lpad(CAST("month" AS VARCHAR), 2, '0') || '-01'
      ELSE ' ПЕРИОД: ' || CASE WHEN kind = 7 AND flag = 'A' THEN 13 ELSE "month" END || ' месяц '
        || "year" || ' год' END AS head,
    'Итого к оплате: ' || CASE WHEN kind = 7 AND flag = 'N' THEN CAST(amount_1 AS VARCHAR) || '.7'
      ELSE replace(CAST(amount_1 AS VARCHAR), '.', ',') END
    || CASE WHEN flag = 'A' THEN chr(10) || 'Тип кв.: отдельная, К-во комнат: ' || rooms
        || ' Площадь общая: ' || total_area || ', жилая: ' || living_area
        || CASE WHEN kind = 3 THEN '.' ELSE '' END ELSE '' END
    || CASE WHEN flag <> 'R' THEN chr(10) || 'К-во проживающих: ' || residents ELSE '' END
    || CASE WHEN flag = 'A' THEN chr(10) || 'Дата последней оплаты: ' || paid_on ELSE '' END AS tail
  FROM known),
bodies AS (
  SELECT *, head || chr(10) || raw_1 || ' ' || quantity_1 || ' ' || amount_1 || chr(10)
      || raw_2 || ' ' || kind || ',250 ' || amount_2 || chr(10) || tail AS body,
    '<table><tr><th>Услуга</th><th>Объем</th><th>Сумма</th></tr><tr><td>' || raw_1 || '</td><td> '
      || quantity_1 || '&nbsp;м3</td><td><b>' || amount_1 || '</b> руб</td></tr><tr><td>' || raw_2
      || '</td><td> ' || kind || ',250&nbsp;м3</td><td><b>' || amount_2
      || '</b> руб</td></tr></table>' AS cells,
    '<html><head><style>td{{color:red}}</style></head><body><!-- 1 --><p>' || head || '</p>' AS top,
    '<p>' || replace(tail, chr(10), '<br>') || '</p></body></html>' AS bottom,
    '<p>Новости</p><table><tr><td>ТКО</td><td>без чисел</td><td>нет</td></tr></table>' AS news
  FROM texts)
"""

_CHECKS = (
    ("accounts.account_number not null", "SELECT count(*) FROM addresses WHERE account_number IS NULL"),
    ("accounts.address not null", "SELECT count(*) FROM addresses WHERE address IS NULL"),
    ("periods.month range", 'SELECT count(*) FROM (SELECT DISTINCT "year", "month" FROM heads) WHERE "month" NOT BETWEEN 1 AND 12'),
    ("charges.account not null", "SELECT count(*) FROM named WHERE account_number IS NULL"),
    ("charges.service not null", "SELECT count(*) FROM named WHERE service IS NULL"),
    ("charges.month range", 'SELECT count(*) FROM named WHERE "month" NOT BETWEEN 1 AND 12'),
    ("analysis.prompt not null", "SELECT count(*) FROM analyses WHERE prompt IS NULL"),
    ("analysis.response not null", "SELECT count(*) FROM analyses WHERE response IS NULL"),
    ("analysis.model not null", "SELECT count(*) FROM analyses WHERE model IS NULL"),
    ("accounts unique", "SELECT count(*) FROM (SELECT account_number FROM addresses GROUP BY 1 HAVING count(*) > 1)"),
    ("periods unique", 'SELECT count(*) FROM (SELECT "year", "month" FROM (SELECT DISTINCT "year", "month" FROM heads) GROUP BY 1, 2 HAVING count(*) > 1)'),
    ("services unique", "SELECT 0"),
    ("charge lines unique", 'SELECT count(*) FROM (SELECT account_number FROM named GROUP BY account_number, "year", "month", service HAVING count(*) > 1)'),
    ("analysis log unique", 'SELECT count(*) FROM (SELECT address FROM analyses GROUP BY address, "year", "month" HAVING count(*) > 1)'),
    ("charges.account exists", "SELECT count(*) FROM named WHERE account_number NOT IN (SELECT account_number FROM addresses)"),
    ("charges.period exists", 'SELECT count(*) FROM named n WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h."year" = n."year" AND h."month" = n."month")'),
    ("charges.service exists", f"SELECT count(*) FROM named WHERE service NOT IN (SELECT {_CANONICAL.format('r')} FROM (SELECT {_RAW.format('p_partkey')} AS r FROM part))"),
    ("analysis.period exists", 'SELECT count(*) FROM analyses a WHERE NOT EXISTS (SELECT 1 FROM heads h WHERE h."year" = a."year" AND h."month" = a."month")'),
)

# Fixed value: whitespace that RE2 does not count as ``\s``.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_ESCAPED = (
    "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
    " '\"', '&quot;'), '''', '&#x27;')"
)

# The references that the sample pages use; ``&amp;`` comes last.
_REFERENCES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&mdash;", "—"), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
)


def _visible() -> str:
    """Visible text of the sample pages from their pieces between ``<``: what stands behind a tag's ``>``
    counts unless an element that hides its text is open there."""
    text = "string_agg(shown, ' ' ORDER BY i)"
    for name, char in _REFERENCES:
        text = f"regexp_replace({text}, '{name}?', '{char}', 'g')"
    return f"""WITH pieces AS (
  SELECT page_id, generate_subscripts(string_split(html, '<'), 1) AS i, unnest(string_split(html, '<')) AS piece FROM pages),
tags AS (
  SELECT *, lower(regexp_extract(piece, '^/?[a-zA-Z0-9]+')) AS tag, strpos(piece, '>') AS closed FROM pieces),
opened AS (
  SELECT *, sum(CASE WHEN tag IN ('script', 'style', 'template') THEN 1
    WHEN tag IN ('/script', '/style', '/template') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS hidden
  FROM tags),
shown AS (
  SELECT page_id, i, CASE WHEN i = 1 THEN piece WHEN hidden > 0 THEN ''
    WHEN tag = '' AND piece NOT LIKE '!%' THEN '<' || piece ELSE substr(piece, closed + 1) END AS shown
  FROM opened)
SELECT page_id, md5(trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'))) AS text_md5 FROM shown GROUP BY page_id"""


def _markdown(text: str) -> str:
    """Enough for the marked texts of the samples, without lookaround."""
    out = _ESCAPED.format(text)
    for pattern, new in (
        (r"(?m)^### (.*?)$", r"<b>\1</b>"),
        (r"\*\*(.*?)\*\*", r"<b>\1</b>"),
        (r"\*([^*\n]*?)\*", r"<i>\1</i>"),
        (r"(?m)^([ ]*)[*-] ", r"\1• "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


def _sql(select: str, *parts: str) -> str:
    return "WITH " + ",".join(parts or (_TABLES,)) + " " + select


_AS_DOUBLE = "CAST(quantity AS DOUBLE) AS quantity, CAST(amount_due AS DOUBLE) AS amount_due"

_PROMPT = """
, prompt_items AS (
  SELECT address, "year", "month", any_value(ym) AS ym,
    '- Итого к оплате: ' || CAST(sum(amount_due) AS VARCHAR) || ' руб.' || chr(10) || '- Структура услуг:'
    || chr(10) || string_agg('  * ' || service || ': количество ' || CAST(quantity AS VARCHAR)
      || ', средний тариф ' || format('{:.2f}', CASE WHEN quantity > 0
        THEN CAST(amount_due AS DOUBLE) / CAST(quantity AS DOUBLE) ELSE 0 END)
      || ' руб., сумма ' || CAST(amount_due AS VARCHAR) || ' руб.' || chr(10), '' ORDER BY service) AS block,
    '  ' || any_value(ym) || ':' || chr(10) || string_agg('    ' || service || ': '
      || CAST(amount_due AS VARCHAR) || ' руб.' || chr(10), '' ORDER BY service) AS hist
  FROM months GROUP BY address, "year", "month"),
prompt_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY "year", "month") AS k FROM prompt_items),
prompt_hist AS (
  SELECT a.address, a.k, count(*) AS n, string_agg(b.hist, '' ORDER BY b.k) AS history
  FROM prompt_ranked a JOIN prompt_ranked b ON a.address = b.address AND b.k BETWEEN a.k - 11 AND a.k
  GROUP BY a.address, a.k)
SELECT a.address, a."year", a."month",
  'Ты аналитик ЖКХ. Проведи анализ ЕПД для адреса: ' || a.address || ' за период ' || a.ym || '.'
  || chr(10) || chr(10) || 'Данные за ' || a.ym || ' (агрегированы по всем лицевым счетам):' || chr(10)
  || a.block || chr(10)
  || coalesce('Данные за предыдущий месяц ' || p.ym || ':' || chr(10) || p.block,
       'Данные за предыдущий месяц отсутствуют.' || chr(10))
  || chr(10) || 'Динамика за последние 12 месяцев (доступно ' || h.n || ' месяцев):' || chr(10)
  || h.history || chr(10) || 'TASK' AS prompt
FROM prompt_ranked a JOIN prompt_hist h ON h.address = a.address AND h.k = a.k
LEFT JOIN prompt_ranked p ON p.address = a.address AND p.k = a.k - 1
WHERE NOT EXISTS (SELECT 1 FROM analyses x
  WHERE x.address = a.address AND x."year" = a."year" AND x."month" = a."month")
"""

# Fixed value: the closing instructions of a prompt.
_TASK = """Требуется:
1. Анализ текущего месяца: структура потребления и стоимости, выделение основных услуг.
2. Сравнение с предыдущим месяцем: изменения в потреблении и стоимости, основные причины роста/снижения (если предыдущий месяц есть).
3. Анализ динамики за последние 12 месяцев (если достаточно данных): тренды, сезонность, структурные изменения. Если данных меньше 12, проанализируй доступные месяцы и укажи, что данных недостаточно для полноценного годового анализа, но дай характеристику имеющейся динамики.

Ответ дай в свободной форме, но структурированно, с цифрами и выводами. Будь краток, но информативен.
"""


_UNANSWERED = """WHERE NOT EXISTS (SELECT 1 FROM analyses x
  WHERE x.address = a.address AND x."year" = a."year" AND x."month" = a."month")"""

# The delivery that brings a message: its first hexadecimal digit of the MD5 of its id, modulo 3.
_DELIVERY = "(strpos('0123456789abcdef', substr(md5(msg_id), 1, 1)) - 1) % 3"

_MAIL_MONTHS = """mail_months AS (
  SELECT address, "year", "month", service, sum(quantity) AS quantity, sum(amount) AS amount_due,
    "year" || '-' || lpad(CAST("month" AS VARCHAR), 2, '0') AS ym
  FROM mail_charges GROUP BY ALL)
"""

# Bills that name one of three flats each, and the flat that an account's first bill names.
_MOVING = _MAIL.replace(
    "account_number, address, \"year\"", "account_number, address || ', кв. ' || (l_orderkey % 3) AS address, \"year\""
)
_MOVED = """flats AS (
  SELECT account_number, address FROM outcome WHERE accepted AND (reason IS NULL OR reason = 'bad_month')
  QUALIFY row_number() OVER (PARTITION BY account_number ORDER BY received_at, msg_id) = 1)
"""


_HOMES = "SELECT *, CAST(account_number AS BIGINT) AS k FROM addresses"
_CATALOGUE = f"SELECT DISTINCT {_CANONICAL.format('r')} AS name FROM (SELECT {_RAW.format('p_partkey')} AS r FROM part)"
_STORED_INFO = """SELECT DISTINCT account_number, "year", "month" FROM known
  WHERE flag <> 'R' AND kind <> 6 AND kind <> 7 AND NOT (kind = 3 AND flag = 'A')"""

# The tables that all constraints are checked on: as stored, and with planted violations.
_STORED = f"""t_accounts AS (SELECT account_number, address FROM addresses),
t_periods AS (SELECT DISTINCT "year", "month", make_date("year", "month", 1) AS start_date FROM heads),
t_services AS ({_CATALOGUE}),
t_charges AS (SELECT account_number, "year", "month", service FROM charges),
t_account_period_info AS ({_STORED_INFO}),
t_raw_imports AS (SELECT 'email' AS source_type, account_number FROM known WHERE kind NOT IN (6, 7) OR (kind = 7 AND flag = 'R')),
t_address_analysis AS (SELECT address, "year", "month", prompt, response, model FROM latest)
"""
_PLANTED = f"""homes AS ({_HOMES}),
flawed AS (SELECT k, CASE WHEN k % 50 <> 7 THEN account_number END AS account_number, CASE WHEN k % 10 <> 3 THEN address END AS address
  FROM homes WHERE k % 20 <> 2),
t_accounts AS (SELECT account_number, address FROM flawed UNION ALL SELECT account_number, address FROM flawed WHERE k % 20 = 1),
months_kept AS (SELECT DISTINCT "year" AS y, "month" AS m FROM heads WHERE "year" <> 1996),
t_periods AS (
  SELECT CASE WHEN m <> 5 THEN y END AS "year", CASE WHEN m = 12 THEN 13 WHEN m <> 4 THEN m END AS "month",
    CASE WHEN m <> 6 THEN make_date(y, m, 1) END AS start_date FROM months_kept
  UNION ALL SELECT y, m, make_date(y, m, 1) FROM months_kept WHERE m = 7),
names AS (SELECT name FROM ({_CATALOGUE}) WHERE name <> 'ТКО'),
t_services AS (SELECT name FROM names UNION ALL SELECT name FROM names WHERE name <> 'ХВС' UNION ALL SELECT NULL),
t_charges AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN account_number END AS account_number, CASE WHEN l_linenumber <> 6 THEN "year" END AS "year",
    CASE WHEN l_linenumber <> 5 THEN "month" END AS "month", CASE WHEN l_linenumber <> 4 THEN service END AS service FROM named),
t_account_period_info AS (
  SELECT CASE WHEN o_orderkey % 5 <> 0 THEN account_number END AS account_number, CASE WHEN o_orderkey % 7 <> 0 THEN "year" END AS "year",
    CASE WHEN o_orderkey % 3 <> 0 THEN "month" END AS "month" FROM heads),
t_raw_imports AS (
  SELECT CASE WHEN o_orderkey % 4 <> 0 THEN 'email' END AS source_type, CASE WHEN o_orderkey % 3 <> 0 THEN account_number END AS account_number
  FROM heads),
t_address_analysis AS (
  SELECT CASE WHEN seq % 2 <> 0 THEN address END AS address, CASE WHEN seq % 3 <> 0 THEN "year" END AS "year",
    CASE WHEN seq % 4 <> 0 THEN "month" END AS "month", CASE WHEN seq % 5 <> 0 THEN prompt END AS prompt,
    CASE WHEN seq % 6 <> 0 THEN response END AS response, CASE WHEN seq % 7 <> 0 THEN model END AS model FROM analyses)
"""

_MONTH_KEY = '"year", "month"'
_NOT_NULL = (
    ("accounts", "account_number address"), ("periods", "year month start_date"), ("services", "name"),
    ("charges", "account_number year month service"), ("account_period_info", "account_number year month"),
    ("raw_imports", "source_type"), ("address_analysis", "address year month prompt response model"),
)
_UNIQUE = (
    ("accounts", "account_number"), ("periods", _MONTH_KEY), ("services", "name"),
    ("charges", f"account_number, {_MONTH_KEY}, service"), ("account_period_info", f"account_number, {_MONTH_KEY}"),
    ("address_analysis", f"address, {_MONTH_KEY}"),
)
_REFERENCES_TO = (
    ("charges", "account_number", "accounts", "c.account_number = p.account_number"),
    ("charges", "year+month", "periods", 'c."year" = p."year" AND c."month" = p."month"'),
    ("charges", "service", "services", "c.service = p.name"),
    ("account_period_info", "account_number", "accounts", "c.account_number = p.account_number"),
    ("account_period_info", "year+month", "periods", 'c."year" = p."year" AND c."month" = p."month"'),
    ("raw_imports", "account_number", "accounts", "c.account_number = p.account_number"),
    ("address_analysis", "year+month", "periods", 'c."year" = p."year" AND c."month" = p."month"'),
)


def _constraints() -> str:
    rules = [(f"{t}.{c} not null", f'SELECT count(*) FROM t_{t} WHERE "{c}" IS NULL') for t, columns in _NOT_NULL for c in columns.split()]
    rules.append(("periods.month range", 'SELECT count(*) FROM t_periods WHERE "month" NOT BETWEEN 1 AND 12'))
    for t, key in _UNIQUE:
        present = " AND ".join(f"{c} IS NOT NULL" for c in key.split(", "))
        rules.append((f"{t} unique", f"SELECT count(*) FROM (SELECT 1 FROM t_{t} WHERE {present} GROUP BY {key} HAVING count(*) > 1)"))
    for t, key, parent, on in _REFERENCES_TO:
        present = " AND ".join(f'c."{c}" IS NOT NULL' for c in key.split("+"))
        rules.append((f"{t}.{key} exists", f"SELECT count(*) FROM t_{t} c WHERE {present} AND NOT EXISTS (SELECT 1 FROM t_{parent} p WHERE {on})"))
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for rule, sql in rules)


_ASKED = "address = 'NATION_19, MACHINERY'"


def _report(months: str, billed: str, analyses: str | None) -> str:
    response = (
        f"coalesce({_markdown('l.response')}, '<i>Анализ не проведен (ошибка сервиса ИИ)</i>')"
        if analyses
        else "'<i>Анализ не проведен (ошибка сервиса ИИ)</i>'"
    )
    join = f'LEFT JOIN {analyses} l USING (address, "year", "month")' if analyses else ""
    return f"""
, report_bodies AS (
  SELECT address, "year", "month", '💰 <b>Итого: ' || format('{{:,.2f}}', CAST(sum(amount_due) AS DOUBLE))
    || ' руб.</b>, в т.ч.:' || string_agg(chr(10) || '🔹 <b>' || service || ':</b> '
      || format('{{:,.2f}}', CAST(amount_due AS DOUBLE)) || ' руб. <i>'
      || replace(CAST(quantity AS VARCHAR) || ' ?', '.', ',') || '</i>', ''
      ORDER BY amount_due DESC, service) AS body
  FROM {months} GROUP BY address, "year", "month"),
billed AS (SELECT DISTINCT address, account_number, "year", "month" FROM {billed})
SELECT address, account_number, "year", "month",
  '<b>Анализ ЕПД</b>' || chr(10) || '🏠 <b>Адрес:</b> ' || address || chr(10) || '🆔 <b>Лицевой счет:</b> '
  || account_number || chr(10) || '📅 <b>Период:</b> ' || "year" || '-' || lpad(CAST("month" AS VARCHAR), 2, '0')
  || chr(10) || chr(10) || coalesce(body, '💰 <b>Итого: данные не найдены</b>') || chr(10) || chr(10)
  || '<b>Анализ:</b>' || chr(10) || {response} AS message
FROM billed LEFT JOIN report_bodies USING (address, "year", "month") {join}
"""


ORACLE_SQL = {
    "accounts_dim": _sql(
        "SELECT DISTINCT account_number, address FROM bills"
    ),
    "periods_dim": _sql(
        'SELECT DISTINCT "year", "month", CAST(make_date("year", "month", 1) AS VARCHAR) AS start_date FROM heads'
    ),
    "services_dim": _sql("SELECT DISTINCT service AS name, '?' AS unit FROM named"),
    "service_name_normalize": _sql(
        "SELECT raw_service, service AS name, count(*) AS n FROM named GROUP BY ALL"
    ),
    "charges_upsert": _sql(
        f'SELECT account_number, "year", "month", service, {_AS_DOUBLE}, '
        "CAST(0 AS DOUBLE) AS accrued_by_tariff FROM charges"
    ),
    "period_info_upsert": _sql(
        """SELECT account_number, "year", "month", CASE WHEN flag = 'A' THEN CAST(total_area AS DOUBLE) END AS total_area,
        CASE WHEN flag = 'A' THEN CAST(living_area AS DOUBLE) END AS living_area,
        CASE WHEN flag = 'A' THEN CAST(rooms AS INT) END AS rooms, CAST(residents AS INT) AS residents,
        CASE WHEN flag = 'A' THEN paid_on END AS last_payment_date
        FROM known WHERE flag <> 'R' AND kind <> 6 AND kind <> 7 AND NOT (kind = 3 AND flag = 'A')
        QUALIFY row_number() OVER (PARTITION BY account_number, "year", "month"
          ORDER BY received_at DESC, msg_id DESC) = 1""",
        _TABLES, _MAIL,
    ),
    "raw_imports_audit": _sql(
        """SELECT 'email' AS source_type, account_number, count(*) AS n, max(msg_id) AS last_source
        FROM outcome WHERE accepted AND reason IS NULL GROUP BY account_number""",
        _TABLES, _MAIL,
    ),
    "constraint_checks": _sql(
        " UNION ALL ".join(
            f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for rule, sql in _CHECKS
        )
    ),
    "addresses_distinct": _sql("SELECT DISTINCT trim(address) AS address FROM bills ORDER BY 1"),
    "accounts_by_address": _sql("SELECT DISTINCT address, account_number FROM bills ORDER BY 1, 2"),
    "services_list": _sql("SELECT DISTINCT service AS name, '?' AS unit FROM named ORDER BY 1"),
    "periods_for_accounts": _sql(
        'SELECT DISTINCT account_number, "year", "month" FROM lines ORDER BY 2 DESC, 3 DESC'
    ),
    "address_month_breakdown": _sql(
        f"""SELECT address, "year", "month", service AS name, '?' AS unit, {_AS_DOUBLE} FROM months"""
    ),
    "address_month_service": _sql(
        f"""SELECT address, "year", "month", service, {_AS_DOUBLE}, CASE WHEN quantity > 0
        THEN CAST(amount_due AS DOUBLE) / CAST(quantity AS DOUBLE) ELSE 0 END AS tariff FROM months"""
    ),
    "previous_period": _sql(
        """SELECT a.address, a."year", a."month", p."year" AS prev_year, p."month" AS prev_month
        FROM ranked a LEFT JOIN ranked p ON p.address = a.address AND p.k = a.k - 1"""
    ),
    "month_over_month": _sql(
        """, current_rows AS (
          SELECT r.address, r."year", r."month", p."year" AS prev_year, p."month" AS prev_month, m.service,
            m.amount_due FROM ranked r JOIN months m USING (address, "year", "month")
          LEFT JOIN ranked p ON p.address = r.address AND p.k = r.k - 1),
        previous_rows AS (
          SELECT r.address, r."year", r."month", p."year" AS prev_year, p."month" AS prev_month, m.service,
            m.amount_due FROM ranked r JOIN ranked p ON p.address = r.address AND p.k = r.k - 1
          JOIN months m ON m.address = p.address AND m."year" = p."year" AND m."month" = p."month")
        SELECT coalesce(c.address, p.address) AS address, coalesce(c."year", p."year") AS "year",
          coalesce(c."month", p."month") AS "month", coalesce(c.prev_year, p.prev_year) AS prev_year,
          coalesce(c.prev_month, p.prev_month) AS prev_month, coalesce(c.service, p.service) AS service,
          CAST(c.amount_due AS DOUBLE) AS amount, CAST(p.amount_due AS DOUBLE) AS prev_amount
        FROM current_rows c FULL JOIN previous_rows p ON c.address = p.address AND c."year" = p."year"
          AND c."month" = p."month" AND c.service = p.service"""
    ).replace(") , current_rows", "), current_rows"),
    "trailing_12_months": _sql(
        """SELECT a.address, a."year", a."month", h."year" AS hist_year, h."month" AS hist_month, m.service,
          CAST(m.amount_due AS DOUBLE) AS amount_due
        FROM ranked a JOIN ranked h ON h.address = a.address AND h.k BETWEEN a.k - 11 AND a.k
        JOIN months m ON m.address = h.address AND m."year" = h."year" AND m."month" = h."month\""""
    ),
    "trailing_12_map": _sql(
        """, items AS (
          SELECT address, ym, ym || ':' || string_agg(service || '=' || CAST(amount_due AS VARCHAR), ','
            ORDER BY service) AS item, row_number() OVER (PARTITION BY address ORDER BY ym) AS k
          FROM months GROUP BY address, ym)
        SELECT a.address, a.ym, CAST(count(*) AS INT) AS n_months, string_agg(h.item, ';' ORDER BY h.k) AS history
        FROM items a JOIN items h ON h.address = a.address AND h.k BETWEEN a.k - 11 AND a.k
        GROUP BY a.address, a.ym"""
    ),
    "chart_long": _sql(
        """SELECT address, label, service, CAST(amount AS DOUBLE) AS amount, CAST(quantity AS DOUBLE) AS quantity,
        CASE WHEN quantity <> 0 THEN CAST(amount AS DOUBLE) / CAST(quantity AS DOUBLE) ELSE 0 END AS tariff FROM grid"""
    ),
    "month_totals": _sql(
        "SELECT address, label, CAST(sum(amount) AS DOUBLE) AS total FROM grid GROUP BY address, label"
    ),
    "chart_json": _sql(
        """SELECT address, service, string_agg(label, ',' ORDER BY label) AS months,
        string_agg(CAST(CAST(amount AS DECIMAL(38,2)) AS VARCHAR), ',' ORDER BY label) AS amounts,
        string_agg(CAST(CAST(quantity AS DECIMAL(38,3)) AS VARCHAR), ',' ORDER BY label) AS quantities,
        CAST(count(*) AS INT) AS n_tariffs FROM grid GROUP BY address, service"""
    ),
    "missing_analysis": _sql(
        """SELECT address, "year", "month" FROM charged c WHERE NOT EXISTS (SELECT 1 FROM analyses a
        WHERE a.address = c.address AND a."year" = c."year" AND a."month" = c."month")"""
    ),
    "missing_analysis_topn": _sql(
        """SELECT address, "year", "month" FROM charged c WHERE NOT EXISTS (SELECT 1 FROM analyses a
        WHERE a.address = c.address AND a."year" = c."year" AND a."month" = c."month")
        ORDER BY "year" DESC, "month" DESC, address LIMIT 50"""
    ),
    "analysis_upsert": _sql('SELECT address, "year", "month", response, model, tokens_used FROM latest'),
    "latest_analysis": _sql(
        """SELECT address, "year", "month", response, model, strftime(created_at, '%Y-%m-%d') AS created_at
        FROM latest"""
    ),
    "analysis_prompt": _sql(_PROMPT.replace("TASK", _TASK)),
    "report_text": _sql(_report("months", "bills", "latest")),
    "truncate_message": """SELECT doc_id, md5(CASE WHEN length(text) > 4000
        THEN substring(text, 1, 4000) || '... (обрезано)' ELSE text END) AS message_md5 FROM documents""",
    "html_escape": f"SELECT page_id, md5({_ESCAPED.format('html')}) AS escaped_md5 FROM pages",
    "markdown_to_html": f"""WITH marked AS (SELECT conv_id, turn, '### ' || role || chr(10) || '**Итог:** '
        || text || chr(10) || '  * пункт *важно* & <1>' || chr(10) || '- ' || role AS md FROM conversations)
        SELECT conv_id, turn, md5({_markdown("md")}) AS html_md5 FROM marked""",
    "whitespace_collapse": f"SELECT doc_id, md5(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) AS text_md5 FROM documents",
    "html_visible_text": _visible(),
    "number_tokens": r"""WITH found AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\d\.,]+'),
          lambda t: TRY_CAST(replace(t, ',', '.') AS DOUBLE) IS NOT NULL) AS tokens FROM documents)
        SELECT doc_id, CAST(len(tokens) AS INT) AS n, md5(array_to_string(tokens, ' ')) AS tokens_md5,
          CASE WHEN len(tokens) >= 2 THEN TRY_CAST(replace(tokens[-2], ',', '.') AS DOUBLE) END AS before_last,
          CASE WHEN len(tokens) >= 1 THEN TRY_CAST(replace(tokens[-1], ',', '.') AS DOUBLE) END AS last
        FROM found""",
    "bill_text_fields": _sql(
        """SELECT msg_id, CASE WHEN kind <> 6 THEN account_number END AS account_number, address, "year",
        CASE WHEN kind = 7 AND flag = 'A' THEN 13 ELSE "month" END AS "month",
        CASE WHEN NOT (kind = 7 AND flag = 'N') THEN CAST(amount_1 AS DOUBLE) END AS total_due,
        CASE WHEN flag = 'A' THEN 'отдельная' END AS apartment_type,
        CASE WHEN flag = 'A' THEN CAST(rooms AS INT) END AS rooms,
        CASE WHEN flag = 'A' THEN CAST(total_area AS DOUBLE) END AS total_area,
        CASE WHEN flag = 'A' AND kind <> 3 THEN CAST(living_area AS DOUBLE) END AS living_area,
        CASE WHEN flag <> 'R' THEN CAST(residents AS INT) END AS residents,
        CASE WHEN flag = 'A' THEN paid_on END AS last_payment_date,
        CASE WHEN kind = 7 AND flag = 'N' THEN 'bad_total' WHEN kind = 3 AND flag = 'A' THEN 'bad_area' END AS defect
        FROM known""",
        _TABLES, _MAIL,
    ),
    "bill_text_services": _sql(
        f"""SELECT msg_id, CAST(CASE WHEN raw_1 = 'Домофон' THEN 0 ELSE line_no END AS INT) AS line_idx,
        {_TEXT_NAME.format("raw")} AS name, CAST(quantity AS DOUBLE) AS quantity,
        CAST(amount AS DOUBLE) AS amount_due FROM mail_lines""",
        _TABLES, _MAIL,
    ),
    "mail_triage": _sql(
        "SELECT msg_id, 'Единый платежный документ' AS h_subject, CAST(accepted AS INT) AS accepted FROM mails",
        _TABLES, _MAIL,
    ),
    "mail_parts": _sql(
        """SELECT msg_id, CAST(0 AS INT) AS part_idx, 'text/plain' AS content_type, md5(body) AS body_md5
          FROM bodies WHERE kind IN (2, 6, 7)
        UNION ALL SELECT msg_id, 1, 'text/plain', md5(body) FROM bodies WHERE kind = 1
        UNION ALL SELECT msg_id, 2, 'text/html', md5(top || cells || bottom) FROM bodies WHERE kind = 1
        UNION ALL SELECT msg_id, 0, 'text/html', md5(top || cells || bottom) FROM bodies WHERE kind = 3
        UNION ALL SELECT msg_id, 1, 'text/html', md5(news) FROM bodies WHERE kind IN (4, 5)
        UNION ALL SELECT msg_id, 2, 'text/html',
          md5(top || '<table><tr><td>' || cells || '</td></tr></table>' || bottom) FROM bodies WHERE kind = 4
        UNION ALL SELECT msg_id, 2, 'text/plain', md5(body) FROM bodies WHERE kind = 5""",
        _TABLES, _MAIL, _WRITTEN,
    ),
    "bill_html_rows": _sql(
        """SELECT msg_id, CAST(CASE WHEN kind = 3 THEN 0 ELSE 2 END AS INT) AS part_idx,
        CAST(CASE WHEN raw_1 = 'Домофон' THEN 0 ELSE line_no END AS INT) AS line_idx, raw AS name,
        CAST(quantity AS DOUBLE) AS quantity, CAST(amount AS DOUBLE) AS amount_due
        FROM mail_lines WHERE kind IN (1, 3, 4)""",
        _TABLES, _MAIL,
    ),
    "bill_first_valid_part": _sql(
        """SELECT msg_id, CAST(CASE WHEN source = 'text' AND kind = 1 THEN 1 WHEN kind IN (1, 4, 5) THEN 2
          ELSE 0 END AS INT) AS part_idx, source AS kind, account_number, n AS n_services
        FROM outcome WHERE accepted AND (reason IS NULL OR reason = 'bad_month')""",
        _TABLES, _MAIL,
    ),
    "bill_quarantine": _sql(
        "SELECT msg_id, reason FROM outcome WHERE accepted AND reason IS NOT NULL", _TABLES, _MAIL
    ),
    "content_hash_name": """SELECT doc_id, 'email_' || doc_id || '_' || substring(md5(text), 1, 8) || '.eml' AS name
        FROM documents""",
    "stream_ingest": _sql(
        """SELECT account_number, "year", "month", service, CAST(quantity AS DOUBLE) AS quantity,
        CAST(amount AS DOUBLE) AS amount_due FROM mail_charges""",
        _TABLES, _MAIL,
    ),
    "stream_affected_reports": _sql(
        _report("mail_months", "(SELECT * FROM outcome WHERE accepted AND reason IS NULL)", None),
        _TABLES, _MAIL,
        """mail_months AS (SELECT address, "year", "month", service, sum(quantity) AS quantity,
          sum(amount) AS amount_due FROM mail_charges GROUP BY ALL)""",
    ),
    "landed_content": """SELECT 'email_' || min(doc_id) || '_' || substring(md5(text), 1, 8) || '.eml' AS name,
        md5(text) AS content_md5 FROM documents WHERE text IS NOT NULL GROUP BY text""",
    "stream_accounts": _sql("SELECT account_number, address FROM flats", _TABLES, _MOVING, _MOVED),
    "stream_month_sums": _sql(
        """SELECT f.address, "year", "month", service, CAST(sum(quantity) AS DOUBLE) AS quantity,
        CAST(sum(amount) AS DOUBLE) AS amount_due FROM mail_charges c JOIN flats f USING (account_number)
        GROUP BY f.address, "year", "month", service""",
        _TABLES, _MOVING, _MOVED,
    ),
    "stream_touched_prompts": _sql(
        _PROMPT.replace("TASK", _TASK).replace("FROM months", "FROM mail_months").replace(
            _UNANSWERED, f"""WHERE EXISTS (SELECT 1 FROM outcome x WHERE x.accepted AND x.reason IS NULL AND {_DELIVERY} = 2
  AND x.address = a.address AND x."year" = a."year" AND x."month" = a."month")"""
        ),
        _TABLES, _MAIL, _MAIL_MONTHS,
    ),
    "stream_open_queue": _sql(
        f"""SELECT DISTINCT m.address, m."year", m."month" FROM mail_months m JOIN outcome x USING (address, "year", "month")
        WHERE x.accepted AND x.reason IS NULL AND {_DELIVERY} = 2""",
        _TABLES, _MAIL, _MAIL_MONTHS,
    ),
    "table_constraints": _sql(_constraints(), _TABLES, _MAIL, _STORED),
    "planted_violations": _sql(_constraints(), _TABLES, _PLANTED),
    "charges_replaced": _sql(f'SELECT account_number, "year", "month", service, {_AS_DOUBLE} FROM charges'),
    "asked_periods": _sql(f'SELECT DISTINCT "year", "month" FROM months WHERE {_ASKED} ORDER BY 1 DESC, 2 DESC'),
    "asked_month": _sql(
        f"""SELECT address, service, {_AS_DOUBLE}, CASE WHEN quantity > 0
        THEN CAST(amount_due AS DOUBLE) / CAST(quantity AS DOUBLE) ELSE 0 END AS tariff
        FROM months WHERE {_ASKED} AND "year" = 1999 AND "month" = 6 ORDER BY service"""
    ),
    "asked_history": _sql(
        f"""SELECT "year", "month", service, CAST(amount_due AS DOUBLE) AS amount_due FROM months
        JOIN (SELECT "year", "month" FROM charged WHERE {_ASKED} AND "year" * 12 + "month" <= 1999 * 12 + 6
          ORDER BY 1 DESC, 2 DESC LIMIT 12) USING ("year", "month")
        WHERE {_ASKED} ORDER BY 1 DESC, 2 DESC, 3"""
    ),
    "chart_payload_rows": _sql(
        """SELECT address, CAST(dense_rank() OVER (PARTITION BY address ORDER BY service) - 1 AS INT) AS service_no, service, label,
        CAST(sum(amount) OVER (PARTITION BY address, label) AS DOUBLE) AS total,
        CAST(amount AS DOUBLE) AS amount, CAST(quantity AS DOUBLE) AS quantity,
        CASE WHEN quantity <> 0 THEN CAST(amount AS DOUBLE) / CAST(quantity AS DOUBLE) ELSE 0 END AS tariff FROM grid"""
    ),
    "chart_of_services": _sql(
        """SELECT address, label, service, CAST(amount AS DOUBLE) AS amount, CAST(quantity AS DOUBLE) AS quantity
        FROM grid WHERE service IN ('ХВС', 'ТКО')"""
    ),
    "addresses_trimmed": _sql(
        "SELECT DISTINCT address FROM bills WHERE CAST(account_number AS BIGINT) % 7 <> 0 ORDER BY 1"
    ),
    "accounts_first_bill": _sql(
        """SELECT account_number, address || ', кв. ' || (o_orderkey % 3) AS address FROM bills
        QUALIFY row_number() OVER (PARTITION BY account_number ORDER BY o_orderdate, o_orderkey) = 1"""
    ),
    "services_first_unit": _sql(
        """SELECT service AS name, 'ед. ' || (l_suppkey % 5) AS unit FROM named QUALIFY row_number() OVER (
        PARTITION BY service ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) = 1"""
    ),
    "breakdown_units": _sql(
        """SELECT service AS name, CASE service WHEN 'ХВС' THEN 'м3' ELSE 'ед.' END AS unit, count(*) AS n,
        CAST(sum(amount_due) AS DOUBLE) AS amount_due FROM months GROUP BY service"""
    ),
    "latest_analysis_known": _sql(
        'SELECT address, "year", "month", response, model FROM latest WHERE "year" <> 1995'
    ),
}
