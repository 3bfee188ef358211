"""Verb queries: each line is a name, the expression in the transform language and the same in DuckDB's SQL.

Results are texts, numbers (rounded to 6 places) and booleans, so that both
engines print them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.plans.compiler import select

#: group: (table, key columns, [(column, expression, SQL)])
ROWS: dict[str, tuple[str, list[str], list[tuple[str, str, str]]]] = {
    "verbs_logic": ("customer", ["c_custkey"], [
        ("concat", '%concat @c_name "/" @c_custkey "/" @c_acctbal', "c_name || '/' || c_custkey || '/' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '')"),
        ("coalesce", '%coalesce ~ "" @c_mktsegment "x"', "c_mktsegment"),
        ("ifNull", '%ifNull ~ @c_name', "c_name"),
        ("ifEmpty", '%ifEmpty "" @c_name', "c_name"),
        ("ifElse", '%ifElse %gt @c_acctbal ##0 "pos" "neg"', "CASE WHEN c_acctbal > 0 THEN 'pos' ELSE 'neg' END"),
        ("cond", '%cond %lt @c_acctbal ##0 "a" %lt @c_acctbal ##5000 "b" "c"', "CASE WHEN c_acctbal < 0 THEN 'a' WHEN c_acctbal < 5000 THEN 'b' ELSE 'c' END"),
        ("switch", '%switch @c_mktsegment "BUILDING" ##1 "MACHINERY" ##2 ##0', "CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS BIGINT)"),
        ("assert_", '%assert %gt @c_acctbal ##0 "positive"', "CASE WHEN c_acctbal > 0 THEN true END"),
        ("and_", '%and %gt @c_acctbal ##0 %eq @c_nationkey ##3', "c_acctbal > 0 AND c_nationkey = 3"),
        ("or_", '%or %gt @c_acctbal ##0 %eq @c_nationkey ##3', "c_acctbal > 0 OR c_nationkey = 3"),
        ("xor_", '%xor %gt @c_acctbal ##0 %eq @c_nationkey ##3', "(c_acctbal > 0) <> (c_nationkey = 3)"),
        ("not_", '%not %gt @c_acctbal ##0', "NOT c_acctbal > 0"),
        ("eq", '%eq @c_nationkey "7"', "c_nationkey = 7"),
        ("ne", '%ne @c_mktsegment "BUILDING"', "c_mktsegment <> 'BUILDING'"),
        ("lt", '%lt @c_acctbal #100.5', "c_acctbal < 100.5"),
        ("lte", '%lte @c_nationkey ##10', "c_nationkey <= 10"),
        ("gt", '%gt @c_name "Customer#000000100"', "c_name > 'Customer#000000100'"),
        ("gte", '%gte @c_nationkey ##10', "c_nationkey >= 10"),
        ("between_", '%between @c_acctbal ##0 ##5000', "c_acctbal BETWEEN 0 AND 5000"),
        ("isNull", '%isNull @c_name', "c_name IS NULL"),
        ("isString", '%isString @c_name', "true"),
        ("isNumber", '%isNumber @c_acctbal', "true"),
        ("isBoolean", '%isBoolean @c_acctbal', "false"),
        ("isArray", '%isArray "[1, 2]"', "true"),
        ("isObject", '%isObject @c_name', "false"),
        ("isDate", '%isDate @c_name', "false"),
        ("typeOf", '%concat %typeOf @c_custkey %typeOf @c_acctbal %typeOf @c_name %typeOf ~', "'integernumberstringnull'"),
    ]),
    "verbs_coercion": ("part", ["p_partkey"], [
        ("coerceString", '%coerceString @p_size', "CAST(p_size AS VARCHAR)"),
        ("coerceNumber", '%coerceNumber %concat @p_size "kg"', "CAST(p_size AS DOUBLE)"),
        ("coerceInteger", '%coerceInteger @p_retailprice', "CAST(floor(p_retailprice) AS BIGINT)"),
        ("coerceBoolean", '%coerceBoolean %ifElse %gt @p_size ##25 "Yes" "no"', "p_size > 25"),
        ("coerceDate", '%coerceDate "3/7/2024"', "'2024-03-07'"),
        ("coerceTimestamp", '%coerceTimestamp "2024-03-07"', "'2024-03-07T00:00:00'"),
        ("toArray", '%join %toArray @p_name ","', "p_name"),
        ("number_of_text", '%add "12.5abc" @p_size', "12.5 + p_size"),
    ]),
    "verbs_strings": ("part", ["p_partkey"], [
        ("upper", '%upper @p_name', "upper(p_name)"),
        ("lower", '%lower @p_type', "lower(p_type)"),
        ("trim", '%trim %concat "  " @p_name " "', "p_name"),
        ("trimLeft", '%trimLeft %concat "  " @p_name " "', "p_name || ' '"),
        ("trimRight", '%trimRight %concat "  " @p_name " "', "'  ' || p_name"),
        ("capitalize", '%capitalize @p_type', "upper(p_type[1]) || lower(p_type[2:])"),
        ("titleCase", '%titleCase @p_type', "array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"),
        ("replace_", '%replace @p_name "a" "_"', "replace(p_name, 'a', '_')"),
        ("replaceRegex", '%replaceRegex @p_brand "[0-9]+" "N"', "regexp_replace(p_brand, '[0-9]+', 'N', 'g')"),
        ("substring_", '%substring @p_name ##2 ##5', "substr(p_name, 3, 5)"),
        ("length_", '%length @p_name', "CAST(strlen(p_name) AS BIGINT)"),
        ("contains_", '%contains @p_type "BRASS"', "contains(p_type, 'BRASS')"),
        ("startsWith", '%startsWith @p_type "PROMO"', "starts_with(p_type, 'PROMO')"),
        ("endsWith", '%endsWith @p_type "STEEL"', "ends_with(p_type, 'STEEL')"),
        ("padLeft", '%padLeft @p_size ##5 "0"', "lpad(CAST(p_size AS VARCHAR), 5, '0')"),
        ("padRight", '%padRight @p_brand ##12 "."', "rpad(p_brand, CAST(greatest(12, length(p_brand)) AS INTEGER), '.')"),
        ("pad", '%pad @p_size ##4 "x"', "rpad(CAST(p_size AS VARCHAR), 4, 'x')"),
        ("center", '%center @p_size ##5 "*"', "repeat('*', (5 - length(CAST(p_size AS VARCHAR))) // 2) || p_size || repeat('*', 5 - length(CAST(p_size AS VARCHAR)) - (5 - length(CAST(p_size AS VARCHAR))) // 2)"),
        ("truncate_", '%truncate @p_name ##4', "left(p_name, 4)"),
        ("split_", '%split @p_type " " ##0', "string_split(p_type, ' ')[1]"),
        ("split_last", '%split @p_type " " ##-1', "string_split(p_type, ' ')[-1]"),
        ("join_", '%join %tokenize @p_type " " "-"', "replace(p_type, ' ', '-')"),
        ("mask_", '%mask @p_brand ##2', "repeat('*', length(p_brand) - 2) || right(p_brand, 2)"),
        ("mask_pattern", '%mask "5551234567" "###-**-####"', "'555-**-3456'"),
        ("reverseString", '%reverseString @p_brand', "reverse(p_brand)"),
        ("repeat_", '%repeat @p_size ##2', "repeat(CAST(p_size AS VARCHAR), 2)"),
        ("camelCase", '%camelCase "order_line-item Total"', "'orderLineItemTotal'"),
        ("snakeCase", '%snakeCase "orderLineHTTPCode"', "'order_line_http_code'"),
        ("kebabCase", '%kebabCase %lower @p_type', "replace(lower(p_type), ' ', '-')"),
        ("pascalCase", '%pascalCase %lower @p_type', "array_to_string(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), '')"),
        ("slugify", '%slugify %concat @p_type "! & Co."', "replace(lower(p_type), ' ', '-') || '-co'"),
        ("match_", '%match @p_brand "#[12]"', "regexp_matches(p_brand, '#[12]')"),
        ("matches_", '%matches @p_type "^(PROMO|SMALL)"', "regexp_matches(p_type, '^(PROMO|SMALL)')"),
        ("extract_", '%extract @p_brand "([0-9])([0-9])" ##2', "nullif(regexp_extract(p_brand, '([0-9])([0-9])', 2), '')"),
        ("extract_between", '%extract "a<b>c" "<" ">"', "'b'"),
        ("normalizeSpace", '%normalizeSpace %concat " " @p_type "  x "', "p_type || ' x'"),
        ("leftOf", '%leftOf @p_type " "', "string_split(p_type, ' ')[1]"),
        ("rightOf", '%rightOf @p_brand "#"', "CASE WHEN contains(p_brand, '#') THEN substr(p_brand, strpos(p_brand, '#') + 1) ELSE '' END"),
        ("wrap", '%wrap "the quick brown fox jumps" ##10', "'the quick' || chr(10) || 'brown fox' || chr(10) || 'jumps'"),
        ("stripAccents", '%stripAccents "Crème Brûlée"', "'Creme Brulee'"),
        ("clean", '%clean %concat "a\\t b  " @p_size', "'a b ' || p_size"),
        ("wordCount", '%wordCount @p_type', "CAST(len(string_split(p_type, ' ')) AS BIGINT)"),
        ("tokenize", '%join %tokenize @p_type " " "|"', "replace(p_type, ' ', '|')"),
        ("levenshtein", '%levenshtein @p_type "PROMO BRUSHED STEEL"', "CAST(levenshtein(p_type, 'PROMO BRUSHED STEEL') AS BIGINT)"),
        ("soundex", '%concat %soundex "Ashcraft" %soundex "Robert" %soundex "Tymczak" %soundex "Pfister"', "'A226R163T522P236'"),
        ("formatPhone", '%formatPhone "5551234567" "US"', "'(555) 123-4567'"),
        ("escapeHtml", '%escapeHtml %concat "<b>&" @p_size', "'&lt;b&gt;&amp;' || p_size"),
        ("unescapeHtml", '%unescapeHtml "&lt;b&gt; &amp;amp; &#65;&#x42;"', "'<b> &amp; AB'"),
        ("escapeXml", '%escapeXml "it\'s"', "'it&apos;s'"),
        ("stripTags", '%stripTags %concat "<p>" @p_name "</p><br"', "p_name"),
    ]),
    "verbs_encoding": ("part", ["p_partkey"], [
        ("base64Encode", '%base64Encode @p_name', "base64(encode(p_name))"),
        ("base64Decode", '%base64Decode %base64Encode @p_name', "p_name"),
        ("base64urlEncode", '%base64urlEncode @p_name', "rtrim(translate(base64(encode(p_name)), '+/', '-_'), '=')"),
        ("base64urlDecode", '%base64urlDecode %base64urlEncode @p_type', "p_type"),
        ("urlEncode", '%urlEncode @p_type', "url_encode(p_type)"),
        ("urlDecode", '%urlDecode %urlEncode @p_brand', "p_brand"),
        ("jsonEncode", '%jsonEncode "a\\"b"', "'a\\\"b'"),
        ("hexEncode", '%hexEncode @p_name', "lower(hex(p_name))"),
        ("hexDecode", '%hexDecode %hexEncode @p_name', "p_name"),
        ("sha256", '%sha256 @p_name', "sha256(p_name)"),
        ("sha1", '%sha1 @p_name', "sha1(p_name)"),
        ("md5", '%md5 @p_name', "md5(p_name)"),
        ("sha512", '%sha512 "abc"', "'ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f'"),
        ("crc32", '%crc32 "abc"', "'352441c2'"),
        ("hmac", '%hmac "The quick brown fox jumps over the lazy dog" "key" "sha256"', "'f7bc83f430538424b13298e6aa6fb143ef4d59a14946175997479dbc2d1a3cd8'"),
        ("canonicalHash", '%canonicalHash @p_name', "sha256('\"' || p_name || '\"')"),
        ("jsonPath", '%jsonPath "{\\"a\\":{\\"b\\":[1,7]}}" "$.a.b[1]"', "'7'"),
        ("stableStringify", '%stableStringify @p_size', "CAST(p_size AS VARCHAR)"),
    ]),
    "verbs_urls": ("pages", ["page_id"], [
        ("scheme", '%get %parseUrl @url "scheme"', "regexp_extract(url, '^([a-z]+)://', 1)"),
        ("host", '%get %parseUrl @url "host"', "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"),
        ("path", '%get %parseUrl @url "path"', "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"),
        ("query", '%buildQuery %parseQuery "b=2&a=1&b=3"', "'a=1&b=3'"),
        ("again", '%buildUrl %parseUrl @url', "url"),
        ("stripTags", '%length %stripTags "<p>x</p>"', "CAST(1 AS BIGINT)"),
    ]),
    "verbs_numeric": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [
        ("add_", '%add @l_quantity @l_tax', "l_quantity + l_tax"),
        ("add_null", '%add ~ @l_linenumber', "CAST(l_linenumber AS DOUBLE)"),
        ("subtract_", '%subtract @l_extendedprice @l_quantity', "l_extendedprice - l_quantity"),
        ("multiply_", '%multiply @l_extendedprice %subtract ##1 @l_discount', "l_extendedprice * (1 - l_discount)"),
        ("divide_", '%divide @l_extendedprice @l_quantity', "l_extendedprice / nullif(l_quantity, 0)"),
        ("safeDivide", '%safeDivide @l_extendedprice @l_discount ##-1', "CASE WHEN l_discount = 0 THEN -1 ELSE l_extendedprice / l_discount END"),
        ("mod_", '%mod @l_orderkey ##7', "CAST(l_orderkey % 7 AS DOUBLE)"),
        ("abs_", '%abs %negate @l_quantity', "abs(l_quantity)"),
        ("negate_", '%negate @l_tax', "-l_tax"),
        ("sign_", '%sign %subtract @l_quantity ##25', "CAST(sign(l_quantity - 25) AS BIGINT)"),
        ("floor_", '%floor @l_extendedprice', "CAST(floor(l_extendedprice) AS BIGINT)"),
        ("ceil_", '%ceil @l_extendedprice', "CAST(ceil(l_extendedprice) AS BIGINT)"),
        ("round_", '%round %negate @l_extendedprice ##1', "floor(-l_extendedprice * 10 + 0.5) / 10"),
        ("trunc_", '%trunc %negate @l_extendedprice', "CAST(trunc(-l_extendedprice) AS BIGINT)"),
        ("pow_", '%pow @l_discount ##2', "l_discount ^ 2"),
        ("sqrt_", '%sqrt @l_quantity', "sqrt(l_quantity)"),
        ("exp_", '%exp @l_discount', "exp(l_discount)"),
        ("ln_", '%ln @l_quantity', "ln(l_quantity)"),
        ("log_", '%log @l_quantity ##2', "ln(l_quantity) / ln(2)"),
        ("log10_", '%log10 @l_quantity', "log10(l_quantity)"),
        ("gcd_", '%gcd @l_partkey @l_suppkey', "gcd(l_partkey, l_suppkey)"),
        ("lcm_", '%lcm @l_linenumber ##6', "lcm(CAST(l_linenumber AS BIGINT), 6)"),
        ("factorial_", '%factorial @l_linenumber', "CAST(factorial(l_linenumber) AS BIGINT)"),
        ("clamp_", '%clamp @l_quantity ##10 ##20', "greatest(10, least(20, l_quantity))"),
        ("minOf", '%minOf @l_quantity ##5 @l_tax', "least(l_quantity, 5, l_tax)"),
        ("maxOf", '%maxOf @l_quantity ##5 @l_tax', "greatest(l_quantity, 5, l_tax)"),
        ("isFinite_", '%isFinite @l_quantity', "isfinite(l_quantity)"),
        ("isNaN_", '%isNaN @l_quantity', "isnan(l_quantity)"),
        ("parseInt", '%parseInt "ff" ##16', "CAST(255 AS BIGINT)"),
        ("formatNumber", '%formatNumber @l_quantity ##2', "printf('%.2f', l_quantity)"),
        ("formatInteger", '%formatInteger @l_extendedprice', "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR)"),
        ("formatCurrency", '%formatCurrency @l_quantity', "printf('%.2f', l_quantity)"),
        ("formatPercent", '%formatPercent @l_discount ##0', "CAST(CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%'"),
        ("formatLocaleNumber", '%formatLocaleNumber #1234567.5 "de"', "'1.234.567,5'"),
        ("convertUnit", '%convertUnit @l_quantity "kg" "g"', "l_quantity * 1000"),
        ("convertUnit_c", '%convertUnit @l_quantity "C" "F"', "floor((l_quantity * 9 / 5 + 32) * 1e6 + 0.5) / 1e6"),
        ("toRadians", '%toRadians @l_quantity', "radians(l_quantity)"),
        ("toDegrees", '%toDegrees @l_tax', "degrees(l_tax)"),
        ("interpolate", '%interpolate @l_quantity ##0 ##0 ##50 ##100', "l_quantity * 2"),
        ("formula", '%expr "l_extendedprice * (1 - l_discount) * (1 + l_tax) - 2 ^ 3" @.', "l_extendedprice * (1 - l_discount) * (1 + l_tax) - 8"),
    ]),
    "verbs_dates": ("orders", ["o_orderkey"], [
        ("formatDate", '%formatDate @o_orderdate "DD/MM/YYYY"', "strftime(o_orderdate, '%d/%m/%Y')"),
        ("parseDate", '%parseDate %formatDate @o_orderdate "DD.MM.YYYY" "DD.MM.YYYY"', "strftime(o_orderdate, '%Y-%m-%d')"),
        ("formatTime", '%formatTime "10:31:45" "HHmm"', "'1031'"),
        ("formatTimestamp", '%formatTimestamp @o_orderdate "YYYY-MM-DD HH:mm"', "strftime(o_orderdate, '%Y-%m-%d %H:%M')"),
        ("parseTimestamp", '%parseTimestamp "20240615 143045" "YYYYMMDD HHmmss"', "'2024-06-15T14:30:45'"),
        ("formatLocaleDate", '%formatLocaleDate @o_orderdate "de"', "day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate)"),
        ("isValidDate", '%isValidDate "2023-02-29" "YYYY-MM-DD"', "false"),
        ("addDays", '%addDays @o_orderdate ##45', "CAST(CAST(o_orderdate AS DATE) + 45 AS VARCHAR)"),
        ("addMonths", '%addMonths @o_orderdate ##13', "strftime(CAST(o_orderdate AS DATE) + INTERVAL 13 MONTH, '%Y-%m-%d')"),
        ("addYears", '%addYears @o_orderdate ##-1', "strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR, '%Y-%m-%d')"),
        ("addHours", '%addHours @o_orderdate ##5', "strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%dT%H:%M:%S')"),
        ("addMinutes", '%addMinutes @o_orderdate ##-90', "strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S')"),
        ("addSeconds", '%addSeconds @o_orderdate ##61', "strftime(o_orderdate + INTERVAL 61 SECOND, '%Y-%m-%dT%H:%M:%S')"),
        ("dateDiff", '%dateDiff "1998-01-31" @o_orderdate "months"', "CAST((year(o_orderdate) * 12 + month(o_orderdate)) - (1998 * 12 + 1) AS BIGINT)"),
        ("daysBetween", '%daysBetweenDates "1998-01-31" @o_orderdate', "CAST(CAST(o_orderdate AS DATE) - DATE '1998-01-31' AS BIGINT)"),
        ("ageFromDate", '%ageFromDate @o_orderdate "2024-02-28"', "CAST(greatest(0, 2024 - year(o_orderdate) - CASE WHEN strftime(o_orderdate, '%m%d') > '0228' THEN 1 ELSE 0 END) AS BIGINT)"),
        ("startOfDay", '%startOfDay @o_orderdate', "strftime(o_orderdate, '%Y-%m-%dT00:00:00')"),
        ("endOfDay", '%endOfDay @o_orderdate', "strftime(o_orderdate, '%Y-%m-%dT23:59:59')"),
        ("startOfMonth", '%startOfMonth @o_orderdate', "strftime(o_orderdate, '%Y-%m-01')"),
        ("endOfMonth", '%endOfMonth @o_orderdate', "CAST(last_day(CAST(o_orderdate AS DATE)) AS VARCHAR)"),
        ("startOfYear", '%startOfYear @o_orderdate', "strftime(o_orderdate, '%Y-01-01')"),
        ("endOfYear", '%endOfYear @o_orderdate', "strftime(o_orderdate, '%Y-12-31')"),
        ("dayOfWeek", '%dayOfWeek @o_orderdate', "CAST(isodow(o_orderdate) AS BIGINT)"),
        ("weekOfYear", '%weekOfYear @o_orderdate', "CAST(weekofyear(o_orderdate) AS BIGINT)"),
        ("quarter_", '%quarter @o_orderdate', "CAST(quarter(o_orderdate) AS BIGINT)"),
        ("isLeapYear", '%isLeapYear @o_orderdate', "(year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0"),
        ("isBefore", '%isBefore @o_orderdate "1998-01-01T00:00:00"', "o_orderdate < TIMESTAMP '1998-01-01'"),
        ("isAfter", '%isAfter @o_orderdate "1998-01-01T00:00:00"', "o_orderdate > TIMESTAMP '1998-01-01'"),
        ("isBetween", '%isBetween @o_orderdate "1996-01-01T00:00:00" "1998-01-01T00:00:00"', "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-01-01'"),
        ("toUnix", '%toUnix @o_orderdate', "CAST(epoch(o_orderdate) AS BIGINT)"),
        ("fromUnix", '%fromUnix %toUnix @o_orderdate', "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')"),
        ("businessDays", '%businessDays "2024-06-14" ##3', "'2024-06-19'"),
        ("nextBusinessDay", '%nextBusinessDay @o_orderdate', "CAST(CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS VARCHAR)"),
        ("formatDuration", '%formatDuration ##93784', "'1 day, 2 hours, 3 minutes, 4 seconds'"),
        ("formatDuration_iso", '%formatDuration "P1DT2H"', "'1 day, 2 hours'"),
    ]),
    "verbs_finance": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey"], [
        ("compound", '%compound @l_extendedprice @l_discount ##3', "l_extendedprice * (1 + l_discount) ^ 3"),
        ("discount_", '%discount @l_extendedprice @l_tax ##2', "l_extendedprice / (1 + l_tax) ^ 2"),
        ("pmt_", '%pmt @l_extendedprice #0.01 ##12', "l_extendedprice * 0.01 * 1.01 ^ 12 / (1.01 ^ 12 - 1)"),
        ("fv_", '%fv @l_quantity #0.05 ##10', "l_quantity * (1.05 ^ 10 - 1) / 0.05"),
        ("pv_", '%pv @l_quantity #0.05 ##10', "l_quantity * (1 - 1.05 ^ -10) / 0.05"),
        ("nper_", '%nper #0.01 #-100 ##1000 ##0', "ln((-100) / (-100 + 1000 * 0.01)) / ln(1.01)"),
        ("rate_", '%rate ##12 #-100 ##1000 ##0', "0.029229"),
        ("depreciation_", '%depreciation @l_extendedprice @l_quantity ##5', "CASE WHEN l_quantity <= l_extendedprice THEN (l_extendedprice - l_quantity) / 5 END"),
        ("distance_", '%distance #40.7128 #-74.006 #51.5074 #-0.1278 "km"', "2 * 6371 * asin(sqrt(sin(radians(51.5074 - 40.7128) / 2) ^ 2 + cos(radians(40.7128)) * cos(radians(51.5074)) * sin(radians(-0.1278 + 74.006) / 2) ^ 2))"),
        ("bearing_", '%bearing ##0 ##0 @l_quantity @l_quantity', "(degrees(atan2(sin(radians(l_quantity)) * cos(radians(l_quantity)), sin(radians(l_quantity)))) + 360) % 360"),
        ("midpoint_", '%get %midpoint ##0 ##0 ##0 @l_quantity "lon"', "l_quantity / 2"),
        ("inBoundingBox", '%inBoundingBox @l_quantity @l_tax ##0 ##0 ##20 ##1', "l_quantity BETWEEN 0 AND 20 AND l_tax BETWEEN 0 AND 1"),
    ]),
}

#: Verbs over the array of an order's lines (quantities q, prices p, in order of place); the SQL sees lists q, p and f.
ARRAYS: dict[str, list[tuple[str, str, str]]] = {
    "verbs_arrays": [
        ("filter_", '%join %map %filter @items "q" ">" ##20 "q" ","', "array_to_string(list_filter(qi, lambda x: x > 20), ',')"),
        ("every_", '%every @items "q" ">" ##5', "len(list_filter(q, lambda x: x > 5)) = len(q)"),
        ("some_", '%some @items "f" "=" "R"', "list_contains(f, 'R')"),
        ("find_", '%get %find @items "q" ">=" ##30 "q"', "list_filter(q, lambda x: x >= 30)[1]"),
        ("findIndex", '%findIndex @items "f" "=" "N"', "CAST(coalesce(list_position(f, 'N'), 0) - 1 AS BIGINT)"),
        ("partition_", '%count %at %partition @items "q" ">" ##20 ##1', "CAST(len(list_filter(q, lambda x: x <= 20)) AS BIGINT)"),
        ("flatten_", '%count %flatten %toArray @items', "CAST(len(q) AS BIGINT)"),
        ("distinct_", '%join %sort %distinct %map @items "f" ","', "array_to_string(list_sort(list_distinct(f)), ',')"),
        ("unique_", '%count %unique %map @items "f"', "CAST(len(list_distinct(f)) AS BIGINT)"),
        ("sort_", '%join %sort %map @items "q" ","', "array_to_string(list_sort(qi), ',')"),
        ("sortDesc_", '%join %sortDesc %map @items "q" ","', "array_to_string(list_reverse_sort(qi), ',')"),
        ("sortBy_", '%join %map %sortBy @items "q" "q" ","', "array_to_string(list_sort(qi), ',')"),
        ("pluck_", '%join %pluck @items "f" ""', "array_to_string(f, '')"),
        ("indexOf_", '%indexOf %map @items "f" "A"', "CAST(coalesce(list_position(f, 'A'), 0) - 1 AS BIGINT)"),
        ("at_", '%at %map @items "q" ##-1', "q[-1]"),
        ("slice_", '%join %slice %map @items "q" ##1 ##3 ","', "array_to_string(qi[2:3], ',')"),
        ("reverse_", '%join %reverse %map @items "f" ""', "array_to_string(list_reverse(f), '')"),
        ("includes_", '%includes %map @items "f" "A"', "list_contains(f, 'A')"),
        ("concatArrays_", '%count %concatArrays @items @items', "CAST(2 * len(q) AS BIGINT)"),
        ("zip_", '%count %zip @items %take @items ##2', "CAST(least(len(q), 2) AS BIGINT)"),
        ("groupBy_", '%join %map %groupBy @items "f" "key" ","', "array_to_string(list_transform(list_filter(range(1, len(f) + 1), lambda i: NOT list_contains(f[1:i - 1], f[i])), lambda i: f[i]), ',')"),
        ("take_", '%join %take %map @items "q" ##2 ","', "array_to_string(qi[1:2], ',')"),
        ("limit_", '%count %limit @items ##3', "CAST(least(len(q), 3) AS BIGINT)"),
        ("drop_", '%count %drop @items ##3', "CAST(greatest(len(q) - 3, 0) AS BIGINT)"),
        ("chunk_", '%count %chunk @items ##2', "CAST((len(q) + 1) // 2 AS BIGINT)"),
        ("range_", '%join %range ##2 ##11 ##3 ","', "'2,5,8'"),
        ("compact_", '%count %compact %map @items "f"', "CAST(len(f) AS BIGINT)"),
        ("sample_", '%count %sample @items ##2 ##7', "CAST(least(len(q), 2) AS BIGINT)"),
        ("dedupe_", '%count %dedupe @items "f"', "CAST(len(list_distinct(f)) AS BIGINT)"),
        ("reduce_", '%reduce %map @items "q" "add" #1', "list_sum(q) + 1"),
        ("pivot_", '%get %pivot @items "f" "q" "A"', "list_last(list_filter(list_zip(f, q), lambda x: x[1] = 'A'))[2]"),
        ("explode_", '%count %explode @items "tags"', "CAST(2 * len(q) AS BIGINT)"),
        ("unpivot_", '%count %unpivot %find @items "q" ">" ##0 "k" "v"', "CAST(6 AS BIGINT)"),
        ("intersection_", '%join %sort %intersection %map @items "f" %tokenize "A R" " " ","', "array_to_string(list_sort(list_filter(list_distinct(f), lambda x: x IN ('A', 'R'))), ',')"),
        ("union_", '%count %union %map @items "f" %tokenize "A Z" " "', "CAST(len(list_distinct(list_concat(f, ['A', 'Z']))) AS BIGINT)"),
        ("difference_", '%join %sort %difference %map @items "f" %tokenize "A R" " " ","', "array_to_string(list_sort(list_filter(list_distinct(f), lambda x: x NOT IN ('A', 'R'))), ',')"),
        ("symmetricDifference_", '%join %sort %symmetricDifference %map @items "f" %tokenize "A Z" " " ","', "array_to_string(list_sort(list_concat(list_filter(list_distinct(f), lambda x: x <> 'A'), list_filter(['A', 'Z'], lambda x: NOT list_contains(f, x)))), ',')"),
    ],
    "verbs_aggregates": [
        ("sum_", '%sum %map @items "q"', "list_sum(q)"),
        ("count_", '%count @items', "CAST(len(q) AS BIGINT)"),
        ("min_", '%min %map @items "p"', "list_min(p)"),
        ("max_", '%max %map @items "p"', "list_max(p)"),
        ("avg_", '%avg %map @items "p"', "list_avg(p)"),
        ("first_", '%first %map @items "q"', "q[1]"),
        ("last_", '%last %map @items "q"', "q[-1]"),
        ("countBy_", '%get %countBy @items "f" "N" ##0', "CAST(len(list_filter(f, lambda x: x = 'N')) AS DOUBLE)"),
        ("keyBy_", '%get %keyBy @items "f" "N.q"', "list_last(list_filter(list_zip(f, q), lambda x: x[1] = 'N'))[2]"),
        ("countIf_", '%countIf @items "f" "startsWith" "N"', "CAST(len(list_filter(f, lambda x: x = 'N')) AS BIGINT)"),
        ("sumIf_", '%sumIf @items "f" "=" "R" "q"', "coalesce(list_sum(list_transform(list_filter(list_zip(f, q), lambda x: x[1] = 'R'), lambda x: x[2])), 0)"),
        ("avgIf_", '%avgIf @items "f" "=" "R" "q"', "list_avg(list_transform(list_filter(list_zip(f, q), lambda x: x[1] = 'R'), lambda x: x[2]))"),
        ("std_", '%std %map @items "q"', "list_aggregate(q, 'stddev_pop')"),
        ("stdSample_", '%stdSample %map @items "q"', "list_aggregate(q, 'stddev_samp')"),
        ("variance_", '%variance %map @items "q"', "list_aggregate(q, 'var_pop')"),
        ("varianceSample_", '%varianceSample %map @items "q"', "list_aggregate(q, 'var_samp')"),
        ("median_", '%median %map @items "q"', "list_median(q)"),
        ("mode_", '%mode %map @items "d"', "list_first(list_transform(list_sort(list_transform(list_distinct(d), lambda x: {'n': -len(list_filter(d, lambda y: y = x)), 'i': list_position(d, x), 'x': x})), lambda s: s.x))"),
        ("percentile_", '%percentile %map @items "q" ##25', "list_aggregate(q, 'quantile_cont', 0.25)"),
        ("quantile_", '%quantile %map @items "q" #0.9', "list_aggregate(q, 'quantile_cont', 0.9)"),
        ("covariance_", '%covariance %map @items "q" %map @items "p"', "list_sum(list_transform(list_zip(q, p), lambda x: (x[1] - list_avg(q)) * (x[2] - list_avg(p)))) / len(q)"),
        ("weightedAvg_", '%weightedAvg %map @items "p" %map @items "q"', "list_sum(list_transform(list_zip(q, p), lambda x: x[1] * x[2])) / nullif(list_sum(q), 0)"),
        ("zscore_", '%zscore %first %map @items "q" %map @items "q"', "(q[1] - list_avg(q)) / nullif(list_aggregate(q, 'stddev_pop'), 0)"),
        ("npv_", '%npv #0.1 %map @items "q"', "list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] / 1.1 ^ (i - 1)))"),
        ("irr_", '%irr %concatArrays %toArray #-100 %concatArrays %toArray #60 %toArray #60', "0.130662"),
        ("xnpv_", '%xnpv #0.1 %map @items "q" %map @items "w"', "list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] / 1.1 ^ ((CAST(w[i] AS DATE) - CAST(w[1] AS DATE)) / 365.0)))"),
    ],
    "verbs_windows": [
        ("rowNumber_", '%join %map %rowNumber @items "_rowNum" ","', "array_to_string(range(1, len(q) + 1), ',')"),
        ("rank_", '%join %map %rank @items "q" "desc" "_rank" ","', "array_to_string(list_transform(q, lambda x: len(list_filter(q, lambda y: y > x)) + 1), ',')"),
        ("lag_", '%join %lag %map @items "q" ##1 ##0 ","', "array_to_string(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN i > 1 THEN qi[i - 1] ELSE 0 END), ',')"),
        ("lead_", '%join %lead %map @items "q" ##1 ##0 ","', "array_to_string(list_transform(range(1, len(q) + 1), lambda i: coalesce(qi[i + 1], 0)), ',')"),
        ("shift_", '%join %shift %map @items "q" ##-2 ##9 ","', "array_to_string(list_transform(range(1, len(q) + 1), lambda i: coalesce(qi[i + 2], 9)), ',')"),
        ("cumsum_", '%join %cumsum %map @items "q" ","', "array_to_string(list_transform(range(1, len(q) + 1), lambda i: list_sum(qi[1:i])), ',')"),
        ("cumprod_", '%last %cumprod %map @items "d"', "list_product(d)"),
        ("diff_", '%last %diff %map @items "q"', "CASE WHEN len(q) > 1 THEN q[-1] - q[-2] END"),
        ("pctChange_", '%last %pctChange %map @items "q"', "CASE WHEN len(q) > 1 THEN (q[-1] - q[-2]) / nullif(q[-2], 0) END"),
        ("movingAvg_", '%last %movingAvg %map @items "q" ##3', "list_avg(q[-3:])"),
        ("window_", '%count %window @items ##3', "CAST(greatest(len(q) - 2, 0) AS BIGINT)"),
        ("fillMissing_", '%join %fillMissing %lag %map @items "q" ##1 ~ ##0 "backward" ","', "array_to_string(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN i > 1 THEN qi[i - 1] WHEN len(q) > 1 THEN qi[1] ELSE 0 END), ',')"),
    ],
    "verbs_objects": [
        ("keys_", '%join %sort %keys %first @items ","', "'d,f,p,q,tags,w'"),
        ("values_", '%count %values %pick %first @items "q" "p"', "CAST(2 AS BIGINT)"),
        ("entries_", '%count %entries %pick %first @items "q" "p"', "CAST(2 AS BIGINT)"),
        ("has_", '%has %first @items "q"', "true"),
        ("get_", '%get @items "[0].f" "x"', "f[1]"),
        ("merge_", '%get %merge %first @items %last @items "q"', "q[-1]"),
        ("omit_", '%count %keys %omit %first @items "tags" "w"', "CAST(4 AS BIGINT)"),
        ("fromEntries_", '%first %values %fromEntries %entries %pick %first @items "q"', "q[1]"),
        ("invert_", '%first %keys %invert %pick %first @items "f"', "f[1]"),
        ("defaults_", '%count %keys %defaults %last @items %pick %first @items "q"', "CAST(6 AS BIGINT)"),
        ("compactObject_", '%count %values %compactObject %pick %first @items "f" "w"', "CAST(2 AS BIGINT)"),
        ("toObject_", '%count %keys %toObject %entries %pick %first @items "q"', "CAST(1 AS BIGINT)"),
        ("template_", '%template "{f}-{none}" %first @items', "f[1] || '-'"),
        ("stable_", '%stableStringify %pick %first @items "q" "f"', "'{\"f\":\"' || f[1] || '\",\"q\":' || CAST(q[1] AS BIGINT) || '}'"),
    ],
}


def tidy(df: DataFrame) -> DataFrame:
    """Integers as bigint, doubles rounded: what both engines print alike."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def _rows(table: str, keys: list[str], lines) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(select(spark.read.parquet(f"{sf_dir}/{table}.parquet"), keys, {n: e for n, e, _ in lines}))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its lines as an array in order of place: the map-side part of the array queries."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    item = F.struct(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), F.col("l_returnflag").alias("f"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("w"), F.array("l_returnflag", "l_linestatus").alias("tags"))
    rank = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("k"), item.alias("x"))))
    return lines.groupBy("l_orderkey").agg(F.transform(ordered, lambda s: s["x"]).alias("items"))


def _arrays(lines) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tidy(select(order_items(spark, sf_dir), ["l_orderkey"], {n: e for n, e, _ in lines}))


def _sql(keys: list[str], lines, source: str) -> str:
    return "SELECT " + ", ".join([*keys, *(f"{sql} AS {n}" for n, _, sql in lines)]) + f" FROM {source}"


def _rounding(inner: str, numbers: set[str]) -> str:
    """Round the double columns of a query's result."""
    if not numbers:
        return inner
    return "SELECT * REPLACE (" + ", ".join(f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in sorted(numbers)) + f") FROM ({inner})"


LIST_SOURCE = """(SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS q, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS qi, list(l_extendedprice ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p, list(l_discount ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS d, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS f, list(strftime(l_shipdate, '%Y-%m-%d') ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS w FROM lineitem GROUP BY l_orderkey)"""

#: Columns that hold doubles, by query.
DOUBLES = {
    "verbs_coercion": {"coerceNumber", "number_of_text"},
    "verbs_numeric": {"add_", "add_null", "subtract_", "multiply_", "divide_", "safeDivide", "mod_", "abs_", "negate_", "round_", "pow_", "sqrt_", "exp_", "ln_", "log_", "log10_", "clamp_", "minOf", "maxOf", "convertUnit", "convertUnit_c", "toRadians", "toDegrees", "interpolate", "formula"},
    "verbs_finance": {"compound", "discount_", "pmt_", "fv_", "pv_", "nper_", "rate_", "depreciation_", "distance_", "bearing_", "midpoint_"},
    "verbs_arrays": {"find_", "at_", "reduce_", "pivot_"},
    "verbs_aggregates": {"sum_", "min_", "max_", "avg_", "first_", "last_", "countBy_", "keyBy_", "sumIf_", "avgIf_", "std_", "stdSample_", "variance_", "varianceSample_", "median_", "mode_", "percentile_", "quantile_", "covariance_", "weightedAvg_", "zscore_", "npv_", "irr_", "xnpv_"},
    "verbs_windows": {"cumprod_", "diff_", "pctChange_", "movingAvg_"},
    "verbs_objects": {"merge_", "fromEntries_"},
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _rows(*spec) for name, spec in ROWS.items()} | {name: _arrays(lines) for name, lines in ARRAYS.items()}
SQL: dict[str, str] = {name: _rounding(_sql(keys, lines, table), DOUBLES.get(name, set())) for name, (table, keys, lines) in ROWS.items()} | {name: _rounding(_sql(["l_orderkey"], lines, LIST_SOURCE), DOUBLES.get(name, set())) for name, lines in ARRAYS.items()}
