"""The registered queries again, as SQL over the raw tables for an independent engine (DuckDB).

Each query is a chain of common table expressions; ``chain`` picks those a query needs.
"""

from __future__ import annotations

import re

from origintrace.constants import (
    ABBREVIATIONS, CLASS_ORDER, COUNTRIES, HASH_DIMENSIONS, MODELLED_COUNTRIES, RELEASE_RENAMES, STOP_WORDS, TABLE_RENAMES,
)
from origintrace.functions.stemming import STEP_2, STEP_3, STEP_4
from origintrace.functions.tokens import WHITESPACE
from origintrace.operators.minhash import PRIME, coefficients

DOC_CLASSES = ["en", "de", "fr", "es"]
N_TABLES = 20
ABBREVIATED = "|".join(re.escape(a) for a in ABBREVIATIONS)


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def bracket_list(column: str) -> str:
    return f"'[' || string_agg(distinct {column}, ', ' order by {column}) || ']'"


def normalized(token: str) -> str:
    blanks = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"trim(trim(lower({token}), {blanks}), '''')"


def bare_list(column: str) -> str:
    return f"case when {column} = '[]' then null else rtrim(ltrim({column}, '['), ']') end as {column}"


def rule_prediction(post_id: str, truth: str, classes: list[str]) -> str:
    h = f"md5({post_id})"
    picks = " ".join(f"when {i} then '{c}'" for i, c in enumerate(classes))
    return (
        f"case when ascii(substr({h}, 1, 1)) % 3 = 0 "
        f"then case ascii(substr({h}, 32, 1)) % {len(classes)} {picks} end else {truth} end"
    )


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTES[name] = (needs, body)


def chain(select: str, *needs: str) -> str:
    """``select`` after the expressions it needs, each once, in order of need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} as materialized ({CTES[n][1]})" for n in order)
    return f"with {parts}\n{select}" if parts else select


# --- posts ----------------------------------------------------------------------------------
cte("lists", [], f"""
  select l.l_orderkey as k, {bracket_list('p.p_brand')} as hashtags, {bracket_list('p.p_type')} as urls,
         {bracket_list('cast(l.l_suppkey as varchar)')} as user_mentions
  from lineitem l join part p on l.l_partkey = p.p_partkey group by l.l_orderkey""")

cte("posts", ["lists"], """
  select case r.r_name when 'EUROPE' then 'russia' when 'ASIA' then 'china' when 'AFRICA' then 'iran'
              when 'AMERICA' then 'venezuela' else 'spain' end as sponsoring_country,
    cast(o.o_orderkey as varchar) as tweetid, cast(o.o_custkey as varchar) as userid,
    d.text as tweet_text, d.lang as tweet_language,
    'http://u.example/' || c.c_mktsegment as user_profile_url,
    case when o.o_orderkey % 3 = 0 then cast(o.o_custkey + 1 as varchar) end as in_reply_to_userid,
    case when o.o_orderkey % 3 = 0 then cast(o.o_orderkey - 1 as varchar) end as in_reply_to_tweetid,
    case when o.o_orderkey % 5 = 0 then cast(o.o_orderkey - 2 as varchar) end as quoted_tweet_tweetid,
    case when o.o_orderkey % 4 = 0 then cast(o.o_custkey + 2 as varchar) end as retweet_userid,
    case when o.o_orderkey % 4 = 0 then cast(o.o_orderkey - 4 as varchar) end as retweet_tweetid,
    case when o.o_orderkey % 7 = 0 then '[]' else lists.hashtags end as hashtags,
    case when o.o_orderkey % 11 = 0 then '[]' else lists.urls end as urls,
    lists.user_mentions as user_mentions
  from orders o join customer c on o.o_custkey = c.c_custkey
    join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
    left join lists on lists.k = o.o_orderkey
    left join documents d on d.doc_id = o.o_orderkey % (select count(*) from documents)""")

cte("clean", ["posts"], f"""
  select sponsoring_country, tweetid, userid, tweet_text, user_profile_url, in_reply_to_userid,
    in_reply_to_tweetid, quoted_tweet_tweetid, retweet_userid, retweet_tweetid,
    {bare_list('hashtags')}, {bare_list('urls')}, {bare_list('user_mentions')}
  from posts where sponsoring_country in ({text_list(MODELLED_COUNTRIES)}) and tweet_text is not null""")

cte("per_user", ["clean"], """
  select sponsoring_country, userid, count(tweetid) as n_posts from clean group by all""")

cte("split", ["per_user"], """
  select sponsoring_country, userid, n_posts, (rn = 1 or cs - n_posts < cap) as is_validation from (
    select *, floor(0.1 * sum(n_posts) over (partition by sponsoring_country)) as cap,
      sum(n_posts) over (partition by sponsoring_country order by md5(sponsoring_country || '|' || userid || '|42')
                         rows between unbounded preceding and current row) as cs,
      row_number() over (partition by sponsoring_country
                         order by md5(sponsoring_country || '|' || userid || '|42')) as rn
    from per_user) q""")

cte("flagged", ["clean", "split"], """
  select c.*, s.is_validation from clean c join split s using (sponsoring_country, userid)""")

# --- token sets -------------------------------------------------------------------------------
_KINDS = {
    "hashtags": ["hashtags"],
    "urls": ["urls", "user_profile_url"],
    "related_tweetids": ["in_reply_to_tweetid", "quoted_tweet_tweetid", "retweet_tweetid", "tweetid"],
    "related_userids": ["user_mentions", "in_reply_to_userid", "retweet_userid", "userid"],
}
_values = lambda c: f"unnest(string_split({c}, ', '))" if c in ("hashtags", "urls", "user_mentions") else c
cte("tokens", ["flagged"], f"""
  select distinct is_validation, sponsoring_country, userid, kind, {normalized('value')} as token from (
    {' union all '.join(
        f"select is_validation, sponsoring_country, userid, '{k}' as kind, {_values(c)} as value from flagged"
        for k, cols in _KINDS.items() for c in cols)}
  ) v where {normalized('value')} <> ''""")

cte("sets", ["tokens"], """
  select distinct case when kind = 'related_userids' then 'users' else 'combined' end as channel,
    is_validation, sponsoring_country, userid, token from tokens""")

cte("sizes", ["sets"], """
  select channel, is_validation, sponsoring_country, userid, count(*) as n from sets group by all""")

cte("shared_tokens", ["sets", "sizes"], """
  select i.*, a.n as n1, b.n as n2 from (
    select t.channel, t.sponsoring_country as train_country, t.userid as train_userid,
      v.sponsoring_country as val_country, v.userid as val_userid, count(*) as shared
    from sets t join sets v on t.channel = v.channel and t.token = v.token
    where not t.is_validation and v.is_validation group by all) i
  join sizes a on a.channel = i.channel and not a.is_validation and a.sponsoring_country = train_country
    and a.userid = train_userid
  join sizes b on b.channel = i.channel and b.is_validation and b.sponsoring_country = val_country
    and b.userid = val_userid""")

cte("pairs", ["shared_tokens"], """
  select channel, train_country, train_userid, val_country, val_userid,
    cast(shared as double) / (n1 + n2 - shared) as similarity
  from shared_tokens where shared * 10 > n1 + n2 - shared""")

# --- scores -----------------------------------------------------------------------------------
cte("scores", ["pairs"], """
  select val_userid as userid, train_country as country, count(*) as neighbours, sum(similarity) as similarity
  from pairs group by all""")

cte("val_users", ["split"], "select distinct userid from split where is_validation")

_slot = lambda c: f"coalesce(sum(case when country = '{c}' then similarity end), 0) as s_{c}"
cte("vectors", ["val_users", "scores"], f"""
  select u.userid, {', '.join(_slot(c) for c in CLASS_ORDER)}
  from val_users u left join scores s on u.userid = s.userid group by u.userid""")

_size = lambda c: f"(select count(*) from split where is_validation and sponsoring_country = '{c}')"
cte("normal", ["vectors", "split"], f"""
  select userid, {', '.join(f"coalesce(s_{c} / nullif({_size(c)}, 0), 0) as n_{c}" for c in CLASS_ORDER)}
  from vectors""")

_most = "greatest(" + ", ".join(f"n_{c}" for c in CLASS_ORDER) + ")"
cte("powers", ["normal"], f"""
  select userid, {', '.join(f"exp(n_{c} - {_most}) as e_{c}" for c in CLASS_ORDER)} from normal""")
_total = " + ".join(f"e_{c}" for c in CLASS_ORDER)
cte("user_level", ["powers"], f"""
  select userid, {', '.join(f"e_{c} / ({_total}) as u_{c}" for c in CLASS_ORDER)} from powers""")

# --- documents ----------------------------------------------------------------------------------
cte("docs", [], """
  select lang as sponsoring_country, cast(doc_id as varchar) as tweetid, source as userid, text as tweet_text,
    substr(md5(cast(doc_id as varchar)), 1, 1) = '0' as is_validation from documents""")

cte("terms", ["docs"], r"""
  select tweetid, term, count(*) as tf from (
    select tweetid, unnest(string_split_regex(lower(tweet_text), '[^\p{L}\p{N}]+')) as term from docs) t
  where term <> '' group by all""")

_words = r"""list_filter(string_split_regex(
    regexp_replace(regexp_replace(regexp_replace(tweet_text, '[-@,;=><]+', ' ', 'g'),
      '(^|[ \n\t\r])([()?!~".]+)', '\1\2 ', 'g'),
      '([()?!~".]+)([ \n\t\r]|\z)', ' \1\2', 'g'), '[ \n\t\r]+'), lambda t: t <> '')"""
cte("words", ["docs"], f"select *, {_words} as words from docs")
cte("kept_words", ["words"], f"""
  select *, list_filter(words, lambda t: lower(t) not in ({text_list(STOP_WORDS)})) as kept from words""")


def no_link(token: str) -> str:
    return f"{token} <> '.' and not starts_with({token}, 'https://t.co/') and not starts_with({token}, 'http://t.co/')"



# --- stems, step by step over the distinct words; conditions read the word in front of a suffix ----
def measured(part: str) -> str:
    """How often a consonant follows a vowel in a string of c and v."""
    return f"len(regexp_extract_all({part}, 'vc'))"


def shaped(word: str) -> str:
    return (f"list_reduce(list_concat([''], string_split({word}, '')), lambda s, x: s || case when x in ('a', 'e', 'i', 'o', 'u') "
            "or (x = 'y' and s[-1:] = 'c') then 'v' else 'c' end)")


def stem_step(name: str, before: str, word: str) -> None:
    """The words after a step, with their shape; words of two letters stay."""
    cte(name, [before], f"""
      select low, uses, w, {shaped('w')} as s from (
        select low, uses, case when length(low) <= 2 then w else {word} end as w from {before}) q""")


def without(n: int | str, column: str = "w") -> str:
    return f"left({column}, greatest(length({column}) - {n}, 0))"


def suffix_step(name: str, before: str, table: dict[str, str], least: int, more: str = "true") -> None:
    """The longest suffix of the table that the word ends in, if the measure before it is over ``least``."""
    ends = " ".join(f"when ends_with(w, '{k}') then '{k}'" for k in sorted(table, key=len, reverse=True))
    stands = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    cte(f"{name}_suffix", [before], f"select *, case {ends} else '' end as x from {before}")
    stem_step(name, f"{name}_suffix", (
        f"case when x <> '' and {measured(without('length(x)', 's'))} > {least} and ({more}) "
        f"then {without('length(x)')} || case x {stands} end else w end"))


def short(word: str, shape: str) -> str:
    return f"({shape}[-3:] = 'cvc' and {word}[-1:] not in ('w', 'x', 'y'))"


cte("vocabulary", ["words"], f"""
  select low, uses, low as w, {shaped('low')} as s from (
    select lower(word) as low, count(*) as uses from (select unnest(words) as word from words) q group by 1) v""")
stem_step("stem_1a", "vocabulary", (
    f"case when ends_with(w, 'sses') or ends_with(w, 'ies') then {without(2)} when ends_with(w, 'ss') then w "
    f"when ends_with(w, 's') then {without(1)} else w end"))
_bare = (f"case when ends_with(w, 'eed') then '' when ends_with(w, 'ed') and contains({without(2, 's')}, 'v') then {without(2)} "
         f"when ends_with(w, 'ed') then '' when ends_with(w, 'ing') and contains({without(3, 's')}, 'v') then {without(3)} else '' end")
cte("stem_1b_bare", ["stem_1a"], f"select *, {_bare} as b, {shaped(f'({_bare})')} as bs from stem_1a")
stem_step("stem_1b", "stem_1b_bare", (
    f"case when ends_with(w, 'eed') and {measured(without(3, 's'))} > 0 then {without(1)} when b = '' then w "
    "when ends_with(b, 'at') or ends_with(b, 'bl') or ends_with(b, 'iz') then b || 'e' "
    f"when bs[-2:] = 'cc' and b[-1:] = b[-2:-2] and b[-1:] not in ('l', 's', 'z') then {without(1, 'b')} "
    f"when {measured('bs')} = 1 and {short('b', 'bs')} then b || 'e' else b end"))
stem_step("stem_1c", "stem_1b", f"case when ends_with(w, 'y') and contains({without(1, 's')}, 'v') then {without(1)} || 'i' else w end")
suffix_step("stem_2", "stem_1c", STEP_2, 0)
suffix_step("stem_3", "stem_2", STEP_3, 0)
suffix_step("stem_4", "stem_3", dict.fromkeys(STEP_4, ""), 1, f"x <> 'ion' or {without(3)}[-1:] in ('s', 't')")
stem_step("stem_5a", "stem_4", (
    f"case when ends_with(w, 'e') and ({measured(without(1, 's'))} > 1 or {measured(without(1, 's'))} = 1 "
    f"and not {short(without(1), without(1, 's'))}) then {without(1)} else w end"))
stem_step("stems", "stem_5a", f"case when ends_with(w, 'll') and {measured(without(1, 's'))} > 1 then {without(1)} else w end")
cte("stemmed_words", ["words", "stems"], f"""
  select tweetid, place, w as token from (
    select tweetid, unnest(words) as word, generate_subscripts(words, 1) as place from words) t
  join stems on low = lower(word) where w not in ({text_list(STOP_WORDS)}) and {no_link("w")}""")
cte("stemmed_tf", ["stemmed_words"], "select tweetid, token as term, count(*) as tf from stemmed_words group by all")


# 32-bit MurmurHash3 of the UTF-8 bytes, in unsigned 64-bit numbers; the multipliers are those of its publication.
def product(a: str, b: int) -> str:
    return f"((({a}) * {b}::ubigint) & 4294967295::ubigint)"


def turned(x: str, bits: int) -> str:
    return f"(((({x}) << {bits}) | (({x}) >> {32 - bits})) & 4294967295::ubigint)"


def mixed(k: str) -> str:
    return product(turned(product(k, 0xCC9E2D51), 15), 0x1B873593)


def folded(h: str, bits: int) -> str:
    return f"xor({h}, ({h}) >> {bits})"


def little_endian(start: str, n: str) -> str:
    """The number in ``n`` bytes of the hexadecimal ``x`` from byte ``start``, lowest byte first."""
    return (f"list_sum(list_transform(range({n}), lambda j: ('0x' || substr(x, 2 * ({start} + j)::int + 1, 2))::bigint << (8 * j)::int))::ubigint")


cte("hashed_words", ["stemmed_tf"], f"""
  select term, {folded('c', 16)} as hash from (select term, {product(folded('b', 13), 0xC2B2AE35)} as c from (
    select term, {product(folded('a', 16), 0x85EBCA6B)} as b from (
      select term, xor(case when n % 4 = 0 then h else xor(h, {mixed(little_endian('n - n % 4', 'n % 4'))}) end, n::ubigint) as a from (
        select *, list_reduce(list_concat([42::ubigint], list_transform(range(n // 4), lambda i: {little_endian('4 * i', '4')})),
          lambda h, k: ({product(turned(f"xor(h, {mixed('k')})", 13), 5)} + 3864292196::ubigint) & 4294967295::ubigint) as h
        from (select term, hex(encode(term)) as x, length(hex(encode(term))) // 2 as n from (select distinct term from stemmed_tf) d) e) f) g) i) j""")
cte("slotted", ["stemmed_tf", "hashed_words"], f"""
  select t.*, (((case when hash >= 2147483648 then hash::bigint - 4294967296 else hash::bigint end) % {HASH_DIMENSIONS}) + {HASH_DIMENSIONS})
    % {HASH_DIMENSIONS} as slot from stemmed_tf t join hashed_words using (term)""")
cte("slot_tf", ["slotted"], "select tweetid, slot, sum(tf)::bigint as tf from slotted group by all")
cte("slot_weights", ["slot_tf", "docs"], """
  select tweetid, slot, tf, round(case when df >= 5 then tf * ln(((select count(*) from docs) + 1e0) / (df + 1)) else 0 end, 6) as tfidf
  from slot_tf join (select slot, count(*) as df from slot_tf group by slot) d using (slot)""")

# --- naive Bayes on terms: log shares by class, smoothed by one --------------------------------------
cte("weighted_terms", ["docs", "terms"], """
  select t.tweetid, t.term, p.sponsoring_country as class, p.is_validation,
    case when df >= 5 then tf * ln(((select count(*) from docs) + 1e0) / (df + 1)) else 0e0 end as x
  from terms t join (select term, count(*) as df from terms group by term) d using (term) join docs p using (tweetid)""")
cte("class_sizes", ["docs"], """
  select class, n_train, weight, row_number() over (order by n desc, class) - 1 as label,
    ln((weight * n_train + 1) / (sum(weight * n_train) over () + count(*) over ())) as prior
  from (select sponsoring_country as class, count(*) as n, count(*) filter (not is_validation) as n_train,
      (select count(*) from docs) / (count(*) over () * cast(count(*) as double)) as weight
    from docs group by 1) q where n_train > 0""")
cte("class_terms", ["weighted_terms", "class_sizes"], """
  select v.term, c.class, coalesce(sum(c.weight * w.x), 0) as mass from (select distinct term from weighted_terms) v cross join class_sizes c
    left join weighted_terms w on w.term = v.term and w.class = c.class and not w.is_validation
  group by all""")
cte("class_logs", ["class_terms"], """
  select term, class, ln(mass + 1) - ln(sum(mass) over (partition by class) + count(*) over (partition by class)) as theta from class_terms""")
cte("class_scores", ["docs", "weighted_terms", "class_logs", "class_sizes"], """
  select d.tweetid, d.userid, d.sponsoring_country, c.class, c.label, c.prior + coalesce(s.score, 0) as score
  from docs d cross join class_sizes c
    left join (select w.tweetid, l.class, sum(w.x * l.theta) as score from weighted_terms w join class_logs l using (term)
      where w.is_validation group by all) s on s.tweetid = d.tweetid and s.class = c.class
  where d.is_validation""")

# --- predictions ----------------------------------------------------------------------------------
cte("doc_votes", ["docs"], f"""
  select *, {rule_prediction('tweetid', 'sponsoring_country', DOC_CLASSES)} as prediction from docs""")
cte("post_votes", ["flagged"], f"""
  select sponsoring_country, tweetid, userid, is_validation,
    {rule_prediction('tweetid', 'sponsoring_country', CLASS_ORDER)} as prediction from flagged""")
_share = lambda c: f"count(*) filter (prediction = '{c}') / cast(count(prediction) as double)"
cte("vote_shares", ["post_votes"], f"""
  select sponsoring_country, userid, {', '.join(f"{_share(c)} as t_{c}" for c in CLASS_ORDER)}
  from post_votes where is_validation group by all""")
cte("wide", ["post_votes"], f"""
  select userid, {', '.join(f"count(*) filter (prediction = '{c}') as v_{c}" for c in CLASS_ORDER)}
  from post_votes group by userid""")
_votes = " + ".join(f"v_{c}" for c in CLASS_ORDER)


def best(columns: dict[str, str]) -> str:
    top = "greatest(" + ", ".join(columns.values()) + ")"
    whens = " ".join(f"when {v} = {top} then '{k}'" for k, v in columns.items())
    return f"case when {top} is null then null when not {top} > 0 then '{CLASS_ORDER[0]}' {whens} end"


cte("ensemble", ["vote_shares", "user_level"], f"""
  select sponsoring_country, t.userid, {', '.join(f"u_{c} * 0.5e0 + t_{c} * 0.5e0 as p_{c}" for c in CLASS_ORDER)}
  from vote_shares t join user_level u on t.userid = u.userid""")
cte("blended", ["post_votes", "user_level", "wide"], f"""
  select l.userid, l.label, {', '.join(
      f"coalesce(u_{c} * 0.5e0 + v_{c} / cast({_votes} as double) * 0.5e0, u_{c}, v_{c} / cast({_votes} as double)) as p_{c}"
      for c in CLASS_ORDER)}
  from (select userid, min(sponsoring_country) as label from post_votes group by userid) l
    left join user_level u on l.userid = u.userid left join wide w on l.userid = w.userid""")

# --- names of raw tables ------------------------------------------------------------------------------
_countries = " ".join(f"when {i} then '{c}'" for i, c in enumerate(COUNTRIES))
cte("dump_names", [], f"""
  select o_orderkey, country || '_' || case
      when m in (8, 11) then lpad(cast(m as varchar), 2, '0') || '2019'
      when m = 1 and country in ('bangladesh', 'venezuela') then 'linked'
      else '2019' || lpad(cast(m as varchar), 2, '0') end
    || case when o_orderstatus = 'F' then '_users' else '_tweets' end || '_csv_hashed' as table_name
  from (select o_orderkey, o_orderstatus, month(o_orderdate) as m, case c_nationkey % 10 {_countries} end as country
        from orders join customer on o_custkey = c_custkey) q""")
_renamed = " ".join(f"when '{a}' then '{b}'" for a, b in TABLE_RENAMES.items())
_release = "case table_name " + _renamed + " else table_name end"
for a, b in RELEASE_RENAMES.items():
    _release = f"replace({_release}, '{a}', '{b}')"
cte("corrected", ["dump_names"], f"select *, {_release} as corrected_name from dump_names")
_owner = " ".join(f"when starts_with(corrected_name, '{c}_') then '{c}'" for c in sorted(COUNTRIES, key=len, reverse=True))
cte("routed", ["corrected"], f"""
  select *, string_split(substr(corrected_name, length(sponsoring_country) + 2), '_')[1] as release
  from (select *, case {_owner} end as sponsoring_country from corrected) q""")

_dated = "lpad(cast(c_custkey % 12 + 1 as varchar), 2, '0')"
_undone = "table_name"
for a, b in RELEASE_RENAMES.items():
    _undone = f"replace({_undone}, '{a}', '{b}')"
cte("account_dumps", [], f"""
  select sponsoring_country, string_split(substr(corrected_name, length(sponsoring_country) + 2), '_')[1] as release, * exclude (sponsoring_country) from (
    select *, {_undone} as corrected_name from (
      select case c_nationkey % 10 {_countries} end as sponsoring_country,
        case c_nationkey % 10 {_countries} end || '_' || case when c_custkey % 12 + 1 in (8, 11) then {_dated} || '2019'
          else '2019' || {_dated} end || '_users_csv_hashed' as table_name,
        cast(c_custkey as varchar) as userid, c_name as user_display_name,
        case when c_custkey % 4 <> 0 then 'u' || c_custkey end as user_screen_name, n_name as user_reported_location,
        'said "' || c_mktsegment || '",' || chr(10) || 'then left' as user_profile_description,
        'http://u.example/' || c_mktsegment as user_profile_url, cast(c_custkey % 1000 as varchar) as follower_count,
        cast(c_custkey % 77 as varchar) as following_count,
        '2015-01-' || lpad(cast(c_custkey % 28 + 1 as varchar), 2, '0') as account_creation_date, 'en' as account_language
      from customer join nation on c_nationkey = n_nationkey) q) r""")

# --- minhash -----------------------------------------------------------------------------------------------
_x = f"(('0x' || substr(md5(token), 1, 8))::bigint % {PRIME})"
cte("numbered", ["sets"], f"select *, {_x} as x from sets")
cte("signed", ["numbered"], f"""
  select channel, is_validation, sponsoring_country, userid,
    {', '.join(f"min((x * {a} + {b}) % {PRIME}) as h{i}" for i, (a, b) in enumerate(coefficients(N_TABLES)))}
  from numbered group by all""")
_agree = " or ".join(f"a.h{i} = b.h{i}" for i in range(N_TABLES))
LSH = f"""
  select p.train_country, p.train_userid, p.val_country, p.val_userid, round(p.similarity, 6) as similarity
  from pairs p
  join signed a on a.channel = p.channel and not a.is_validation and a.sponsoring_country = p.train_country
    and a.userid = p.train_userid
  join signed b on b.channel = p.channel and b.is_validation and b.sponsoring_country = p.val_country
    and b.userid = p.val_userid
  where ({_agree}) and p.channel = """


def oracle_sql() -> dict[str, str]:
    r6 = lambda prefix, out: ", ".join(f"round({prefix}_{c}, 6) as {out}_{c}" for c in CLASS_ORDER)
    post_columns = ("sponsoring_country, tweetid, userid, tweet_text, tweet_language, user_profile_url, "
                    "in_reply_to_userid, in_reply_to_tweetid, quoted_tweet_tweetid, retweet_userid, "
                    "retweet_tweetid, hashtags, urls, user_mentions")
    clean_columns = post_columns.replace("tweet_language, ", "")
    exact = ("select train_country, train_userid, val_country, val_userid, round(similarity, 6) as similarity "
             "from pairs where channel = ")
    return {
        # names and union
        "catalog_route": chain(
            "select corrected_name, sponsoring_country, release, count(*) as n_posts from routed "
            "where corrected_name like sponsoring_country || '_%tweets%' group by all", "routed"),
        "normalize_release": chain(
            "select o_orderkey, corrected_name, sponsoring_country, release from routed", "routed"),
        "combine_posts": chain(
            "select f.*, r.release from (select " + post_columns + " from posts) f "
            "join routed r on f.tweetid = cast(r.o_orderkey as varchar)", "posts", "routed"),
        "filter_lang": chain(f"select {post_columns} from posts where tweet_language = 'en'", "posts"),
        "clean_posts": chain(f"select {clean_columns} from clean", "clean"),
        "ingest_csv": chain(
            "select r.corrected_name as table_name, r.sponsoring_country, r.release, p.tweetid, p.userid, "
            "p.tweet_text, p.tweet_language, p.hashtags, "
            "case when length(r.table_name) % 3 <> 2 then p.urls end as urls, p.user_mentions "
            "from posts p join routed r on p.tweetid = cast(r.o_orderkey as varchar)", "posts", "routed"),
        "combined_users": chain(f"select * exclude (table_name, corrected_name) from account_dumps", "account_dumps"),
        "ingest_manifest": chain(
            "select corrected_name as table_name, sponsoring_country, release, length(table_name) % 2 = 0 as damaged, "
            "case when o_orderstatus = 'F' then 'users' else 'tweets' end as kinds, "
            "case when o_orderstatus <> 'F' and length(table_name) % 3 = 1 then 'tweet_language' else '' end as missing, "
            "case when o_orderstatus <> 'F' and length(table_name) % 3 = 1 then 'note' else '' end as extra, "
            "count(*) as n, 0::bigint as rejected, "
            "sum(case when o_orderstatus = 'F' then o_custkey else o_orderkey end)::bigint as total "
            "from (select r.*, o.o_custkey, case when o.o_orderstatus = 'F' then 'F' else 'O' end as o_orderstatus "
            "from routed r join orders o using (o_orderkey)) q group by all", "routed"),
        "union_releases": chain(
            "select sponsoring_country, case sponsoring_country "
            + " ".join(f"when '{c}' then '2019{i + 1:02}'" for i, c in enumerate([*CLASS_ORDER, "spain"]))
            + " end as release, tweetid, userid, tweet_language, hashtags, urls, user_mentions from posts "
            "where tweet_language = 'en'", "posts"),
        "ingest_quarantine": chain(
            "select r.corrected_name as table_name, count(*) filter (o_orderstatus <> 'P') as accepted, "
            "count(*) filter (o_orderstatus = 'P') as rejected from routed r join orders o on o.o_orderkey = r.o_orderkey "
            "group by 1", "routed"),
        # split
        "tweets_per_user": chain("select * from per_user", "per_user"),
        "split_users": chain("select * from split", "split"),
        "split_counts": chain(
            "select sponsoring_country, is_validation, count(*) as users, sum(n_posts)::bigint as posts "
            "from split group by all", "split"),
        # profiles
        "normalize_tokens": chain(
            f"select tweetid, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split("
            f"coalesce(hashtags, ''), ', '), lambda x: {normalized('x')}), lambda x: x <> ''))), ', ') as tokens "
            "from clean", "clean"),
        "concat_arrays": chain(
            "select tweetid, array_to_string(list_concat(string_split(hashtags, ', '), string_split(urls, ', '), "
            "string_split(user_mentions, ', ')), ', ') as joined from clean", "clean"),
        "user_profiles": chain("select distinct is_validation, sponsoring_country, userid, kind, token from tokens", "tokens"),
        "user_token_counts": chain(
            "select is_validation, sponsoring_country, userid, kind, count(*) as n_tokens from tokens group by all",
            "tokens"),
        # similarity
        "exact_jaccard_combined": chain(exact + "'combined'", "pairs"),
        "exact_jaccard_users": chain(exact + "'users'", "pairs"),
        "similarity_edges": chain(
            "select val_userid, train_userid, train_country as country, channel, round(similarity, 6) as similarity "
            "from pairs", "pairs"),
        "minhash_signatures": chain("select * from signed", "signed"),
        "lsh_similarity_combined": chain(LSH + "'combined'", "pairs", "signed"),
        "lsh_similarity_users": chain(LSH + "'users'", "pairs", "signed"),
        # scores
        "neighbour_scores": chain(
            "select userid, country, neighbours, round(similarity, 6) as similarity from scores", "scores"),
        "similarity_scores": chain(f"select userid, {r6('s', 'score')} from vectors", "vectors"),
        "normalized_scores": chain(f"select userid, {r6('n', 'score')} from normal", "normal"),
        "softmax_scores": chain(f"select userid, {r6('u', 'prob')} from user_level", "user_level"),
        # text
        "sentence_counts": chain(
            rf"select tweetid, len(list_filter(string_split(regexp_replace(regexp_replace(tweet_text, '\b({ABBREVIATED})\.(\s)', "
            r"'\1' || chr(2) || '\2', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: regexp_matches(t, '\S'))) "
            "as n_sentences from docs", "docs"),
        "tokenize": chain("select tweetid, len(words) as n_tokens, array_to_string(words, ' ') as tokens from words", "words"),
        "stopword_filter": chain(
            "select tweetid, len(kept) as n_tokens, array_to_string(kept, ' ') as tokens from kept_words", "kept_words"),
        "drop_url_tokens": chain(
            f"select tweetid, len(list_filter(words, lambda t: {no_link('t')})) as n_tokens, "
            f"array_to_string(list_filter(words, lambda t: {no_link('t')}), ' ') as tokens from words", "words"),
        "prepare_text": chain(
            "select sponsoring_country, tweetid, userid, is_validation, "
            f"array_to_string(list_filter(kept, lambda t: {no_link('t')}), ' ') as ntokens from kept_words", "kept_words"),
        "term_frequency": chain("select * from terms", "terms"),
        "tfidf_terms": chain(
            "select tweetid, term, tf, round(case when df >= 5 then tf * ln(((select count(*) from docs) + 1e0) / (df + 1)) "
            "else 0 end, 6) as tfidf from terms join (select term, count(*) as df from terms group by term) d using (term)",
            "docs", "terms"),
        "stem_vocabulary": chain("select low as word, uses, w as stem from stems", "stems"),
        "stemmed_terms": chain("select tweetid, term, tf from stemmed_tf", "stemmed_tf"),
        "prepare_text_stemmed": chain(
            "select sponsoring_country, tweetid, userid, is_validation, coalesce(ntokens, '') as ntokens from docs left join "
            "(select tweetid, string_agg(token, ' ' order by place) as ntokens from stemmed_words group by tweetid) t using (tweetid)",
            "docs", "stemmed_words"),
        "hashing_tf": chain("select tweetid, slot::int as slot, tf::double as tf from slot_tf", "slot_tf"),
        "tfidf_hashed": chain("select tweetid, slot::int as slot, tfidf from slot_weights", "slot_weights"),
        "hashed_terms": chain("select tweetid, slot::int as slot, tf, tfidf from slot_weights", "slot_weights"),
        "slot_collisions": chain(
            "select slot::int as slot, count(*) as terms, sum(n)::bigint as posts, (sum(n) - max(n))::bigint as lost from "
            "(select slot, term, count(*) as n from slotted group by all) q group by slot", "slotted"),
        "clf_nb_terms": chain(
            "select s.tweetid, s.userid, s.sponsoring_country, own.label::double as label, best.label::double as prediction, "
            "round(best.score, 3) as log_score, best.class as result from (select distinct tweetid, userid, sponsoring_country from class_scores) s "
            "join (select * from class_scores qualify row_number() over (partition by tweetid order by score desc, label) = 1) best using (tweetid) "
            "join class_sizes own on own.class = s.sponsoring_country", "class_scores", "class_sizes"),
        # labels and metrics
        "class_weights": chain(
            "select sponsoring_country, n, round(sum(n) over () / (count(*) over () * cast(n as double)), 6) as weight from "
            "(select sponsoring_country, count(*) as n from docs group by all) q", "docs"),
        "label_index": chain(
            "select sponsoring_country, cast(row_number() over (order by n desc, sponsoring_country) - 1 as double) as label "
            "from (select sponsoring_country, count(*) as n from docs group by all) q", "docs"),
        "weighted_f1": chain("""
            select cast(sum(actual) as bigint) as n, round(sum(2e0 * hits / (actual + predicted) * actual) / sum(actual), 6) as f1 from (
              select class, sum(actual) as actual, sum(predicted) as predicted, sum(hits) as hits from (
                select sponsoring_country as class, count(*) as actual, 0 as predicted,
                  count(*) filter (prediction = sponsoring_country) as hits from doc_votes group by 1
                union all select prediction, 0, count(*), 0 from doc_votes group by 1) u group by class) c
            where actual > 0""", "doc_votes"),
        # votes and ensemble
        "post_vote_probability": chain(
            f"select sponsoring_country, userid, {r6('t', 'share')} from vote_shares", "vote_shares"),
        "pivot_predictions": chain(
            f"select userid, {', '.join(f'v_{c} as votes_{c}' for c in CLASS_ORDER)}, "
            f"{', '.join(f'round(v_{c} / cast({_votes} as double), 6) as share_{c}' for c in CLASS_ORDER)} from wide", "wide"),
        "ensemble_inner": chain(
            f"select sponsoring_country, userid, {best({c: f'p_{c}' for c in CLASS_ORDER})} as result from ensemble", "ensemble"),
        "ensemble_left": chain(
            f"select userid, label, {r6('p', 'prob')}, {best({c: f'p_{c}' for c in CLASS_ORDER})} as prediction from blended",
            "blended"),
        "accuracy": chain(
            f"select count(*) as n, count(*) filter (sponsoring_country = result) as correct, "
            f"round(count(*) filter (sponsoring_country = result) / cast(count(*) as double), 6) as accuracy from "
            f"(select sponsoring_country, {best({c: f'p_{c}' for c in CLASS_ORDER})} as result from ensemble) q", "ensemble"),
    }
