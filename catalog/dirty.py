"""Messy views derived from the clean tables, in SQL that Spark and DuckDB both read.

The given tables hold no nulls, duplicate rows or dirty strings, so each dirt pattern is put on by a
fixed expression over all rows, and ``union all`` repeats some of them. Every row of the table is in
the view.
"""

# lineitem as a spreadsheet export would show it.
LINEITEM = """
with numbered as (
  select *, l_orderkey * 7 + l_linenumber * 3 + l_partkey as k,
         cast(cast(l_extendedprice as decimal(18,2)) as string) as price_text,
         cast(year(l_shipdate) as string) as y,
         lpad(cast(month(l_shipdate) as string), 2, '0') as m,
         lpad(cast(day(l_shipdate) as string), 2, '0') as d,
         substr('JanFebMarAprMayJunJulAugSepOctNovDec', cast(month(l_shipdate) * 3 - 2 as int), 3) as mon
  from {lineitem}
), dirty as (
  select
    'ORD-' || cast(l_orderkey as string) as order_id,
    l_linenumber as line_number,
    case when k % 53 = 0 then '2023-99-99'
         when k % 47 = 0 then 'Pending...'
         when k % 5 = 0 then y || '-' || m || '-' || d
         when k % 5 = 1 then m || '/' || d || '/' || y
         when k % 5 = 2 then d || '-' || mon || '-' || y
         when k % 5 = 3 then y || '/' || m || '/' || d || ' 00:00:00'
         else mon || ' ' || d || ', ' || y end as ship_date,
    case when k % 43 = 0 then 'N/A'
         when k % 4 = 0 then upper(word)
         when k % 4 = 1 then '  ' || word
         when k % 4 = 2 then word || ' '
         else word end as status,
    case when k % 97 = 0 then '9999'
         when k % 41 = 0 then '?'
         else cast(cast(l_quantity as int) as string) end as quantity,
    case when k % 37 = 0 then '$ - '
         when k % 31 = 0 then 'call for price'
         when k % 3 = 0 and l_extendedprice >= 1000
           then '$' || cast(cast(floor(l_extendedprice / 1000) as bigint) as string) || ','
                || substr(price_text, length(price_text) - 5, 6)
         when k % 3 = 1 then price_text || ' USD'
         else '€' || price_text end as price,
    case when k % 29 = 0 then 'zero'
         when k % 2 = 0 then cast(cast(round(l_discount * 100) as int) as string) || '%'
         else cast(cast(l_discount as decimal(18,2)) as string) end as discount_rate,
    cast(110 + k % 60 as string) || '/' || cast(60 + k % 35 as string)
      || case when k % 2 = 0 then ' mmHg' else '' end as reading,
    case when k % 23 = 0 then cast(null as double)
         when k % 89 = 0 then l_tax * 1000
         else l_tax end as tax,
    k
  from (select *, case l_returnflag when 'A' then 'accepted  in-store'
                                    when 'N' then 'new order'
                                    else 'returned' end as word from numbered) w
)
select order_id, line_number, ship_date, status, quantity, price, discount_rate, reading, tax from dirty
union all
select order_id, line_number, ship_date, status, quantity, price, discount_rate, reading, tax from dirty
where k % 61 = 0
"""
