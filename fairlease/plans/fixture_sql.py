"""DuckDB oracle text for the fixture binding (independent SQL, not used by Spark)."""

BINDING = """
b as (
  select l_returnflag rf,
    lpad(cast(s_nationkey as varchar),5,'0') gu_code, n_name gu_name, strftime(l_shipdate,'%Y-%m') ym,
    cast(l_shipdate as date) contract_date,
    case p_type when 'STANDARD' then 'apt' when 'SMALL' then 'rh' when 'MEDIUM' then 'officetel'
         when 'LARGE' then 'detached' when 'ECONOMY' then 'urban' else 'other' end property_type,
    p_type housing_type, p_brand detail_type, cast(nullif(p_size % 9,0) as double) room_count,
    case when l_linestatus='F' then null else cast(l_linenumber as double) end household_size,
    (l_quantity-1)*(l_quantity-1)/7.5 area_m2,
    round(l_extendedprice*100)*10 deposit_won, round(l_extendedprice*100)*10*(1-l_discount*8) support_won,
    case when l_tax<0.04 then 0.0 else round(l_extendedprice*l_tax*10) end monthly_rent_won,
    concat_ws('|',l_orderkey,l_partkey,l_suppkey,l_linenumber,cast(round(l_extendedprice*100) as bigint),
              cast(l_quantity as bigint),strftime(l_shipdate,'%Y-%m'),l_returnflag,l_linestatus) row_key
  from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey
       join part on l_partkey=p_partkey
),
listings as (
  select gu_code, gu_name, ym, contract_date, property_type, housing_type, detail_type, room_count, area_m2,
         household_size, deposit_won, support_won, deposit_won - support_won tenant_deposit_won, monthly_rent_won,
         deposit_won / nullif(area_m2, 0) deposit_per_m2, support_won / nullif(deposit_won, 0) support_ratio, row_key
  from b where rf = 'N'
),
leases as (
  select 'rent' trade_type, property_type, gu_code, gu_name, ym, contract_date, deposit_won, monthly_rent_won, area_m2,
         case when coalesce(monthly_rent_won, 0) = 0 then 'jeonse' else 'monthly' end rent_type,
         deposit_won / nullif(area_m2, 0) deposit_per_m2, monthly_rent_won / nullif(area_m2, 0) monthly_rent_per_m2, row_key
  from b where rf = 'A'
),
sales as (
  select 'sale' trade_type, property_type, gu_code, gu_name, ym, contract_date, deposit_won sale_price_won, area_m2,
         deposit_won / nullif(area_m2, 0) sale_price_per_m2, row_key
  from b where rf = 'R'
),
lease_feats as materialized (
  select gu_code, gu_name, ym, property_type, count(*) rent_txn_count,
         count(*) filter (where rent_type = 'jeonse') jeonse_txn_count,
         median(deposit_won) rent_deposit_median, avg(deposit_won) rent_deposit_mean,
         median(deposit_per_m2) rent_deposit_per_m2_median, avg(deposit_per_m2) rent_deposit_per_m2_mean,
         median(monthly_rent_won) monthly_rent_median, median(area_m2) area_m2_median
  from leases group by all
),
sale_feats as materialized (
  select gu_code, gu_name, ym, property_type, count(*) sale_txn_count,
         median(sale_price_won) sale_price_median, avg(sale_price_won) sale_price_mean,
         median(sale_price_per_m2) sale_price_per_m2_median, avg(sale_price_per_m2) sale_price_per_m2_mean,
         median(area_m2) sale_area_m2_median
  from sales group by all
),
modeling as (
  select l.*, r.rent_txn_count, r.jeonse_txn_count, r.rent_deposit_median, r.rent_deposit_mean,
         r.rent_deposit_per_m2_median, r.rent_deposit_per_m2_mean, r.monthly_rent_median, r.area_m2_median,
         s.sale_txn_count, s.sale_price_median, s.sale_price_mean, s.sale_price_per_m2_median,
         s.sale_price_per_m2_mean, s.sale_area_m2_median,
         l.deposit_won / nullif(r.rent_deposit_median, 0) lh_vs_rent_median_ratio,
         l.deposit_won / nullif(s.sale_price_median, 0) lh_vs_sale_median_ratio,
         r.rent_deposit_median / nullif(s.sale_price_median, 0) jeonse_to_sale_ratio_median
  from listings l
  left join lease_feats r on l.gu_code is not distinct from r.gu_code and l.ym is not distinct from r.ym
       and l.property_type is not distinct from r.property_type
  left join sale_feats s on l.gu_code is not distinct from s.gu_code and l.ym is not distinct from s.ym
       and l.property_type is not distinct from s.property_type
)
"""

CONTENT = (
    "gu_code, gu_name, ym, contract_date, property_type, housing_type, detail_type, room_count, area_m2,"
    " household_size, deposit_won, support_won, tenant_deposit_won, monthly_rent_won, deposit_per_m2, support_ratio"
)

FLAGGED = f"""
, flagged0 as (
  select m.*,
    coalesce(property_type in ('urban','other'), false) is_ood_property_type,
    coalesce(property_type in ('apt','rh','officetel','detached'), false) is_in_domain_property_type,
    row_number() over (partition by {CONTENT} order by row_key) > 1 is_exact_duplicate,
    (area_m2 is null or coalesce(area_m2 <= 0, false)) area_missing_or_zero,
    coalesce(area_m2 > 0 and area_m2 < 5, false) area_too_small,
    coalesce(area_m2 > 150 and area_m2 <= 300, false) area_review_large,
    coalesce(area_m2 > 300, false) area_too_large,
    room_count is null room_missing,
    coalesce(room_count > 6, false) room_too_large,
    (household_size is null or coalesce(household_size <= 0, false)) household_size_missing_or_zero,
    sale_txn_count is null sale_feature_missing,
    (sale_txn_count is not null and coalesce(sale_txn_count < 10, false)) sale_low_confidence,
    rent_txn_count is null rent_feature_missing,
    coalesce(support_ratio < 0.3, false) support_ratio_low,
    coalesce(lh_vs_sale_median_ratio > 1, false) lh_vs_sale_ratio_gt_1,
    coalesce(jeonse_to_sale_ratio_median > 1, false) jeonse_to_sale_ratio_gt_1
  from modeling m
),
clean0 as (
  select *,
    case when not (area_missing_or_zero or area_too_small or area_too_large) then area_m2 end area_m2_clean,
    case when not (room_missing or room_too_large) then room_count end room_count_clean,
    case when not household_size_missing_or_zero then household_size end household_size_clean
  from flagged0
),
clean1 as (select *, deposit_won / nullif(area_m2_clean, 0) deposit_per_m2_clean from clean0),
rm1 as (
  select property_type, housing_type, v from (
    select property_type, housing_type, v, row_number() over (partition by property_type, housing_type order by n desc, v) rn
    from (select property_type, housing_type, room_count_clean v, count(*) n from clean1
          where room_count_clean is not null group by all)) where rn = 1
),
r1 as (
  select c.*, coalesce(c.room_count_clean, m.v) room_count_imputed from clean1 c left join rm1 m
  on c.property_type is not distinct from m.property_type and c.housing_type is not distinct from m.housing_type
),
rm2 as (
  select property_type, v from (
    select property_type, v, row_number() over (partition by property_type order by n desc, v) rn
    from (select property_type, room_count_imputed v, count(*) n from r1 where room_count_imputed is not null group by all))
  where rn = 1
),
r2 as (
  select c.* replace (coalesce(c.room_count_imputed, m.v) as room_count_imputed) from r1 c left join rm2 m
  on c.property_type is not distinct from m.property_type
),
rm3 as (
  select v from (select room_count_imputed v, count(*) n from r2 where room_count_imputed is not null group by all)
  order by n desc, v limit 1
),
r3 as (select c.* replace (coalesce(c.room_count_imputed, (select v from rm3)) as room_count_imputed) from r2 c),
hm1 as (select property_type, detail_type, median(household_size_clean) v from r3 group by all),
h1 as (
  select c.*, coalesce(c.household_size_clean, m.v) household_size_imputed from r3 c left join hm1 m
  on c.property_type is not distinct from m.property_type and c.detail_type is not distinct from m.detail_type
),
hm2 as (select property_type, median(household_size_imputed) v from h1 group by all),
h2 as (
  select c.* replace (coalesce(c.household_size_imputed, m.v) as household_size_imputed) from h1 c left join hm2 m
  on c.property_type is not distinct from m.property_type
),
h3 as (
  select c.* replace (coalesce(c.household_size_imputed, (select median(household_size_imputed) from h2))
                      as household_size_imputed) from h2 c
),
wb as (
  select quantile_cont(lh_vs_rent_median_ratio, 0.01) a_lo, quantile_cont(lh_vs_rent_median_ratio, 0.99) a_hi,
         quantile_cont(lh_vs_sale_median_ratio, 0.01) b_lo, quantile_cont(lh_vs_sale_median_ratio, 0.99) b_hi,
         quantile_cont(jeonse_to_sale_ratio_median, 0.01) c_lo, quantile_cont(jeonse_to_sale_ratio_median, 0.99) c_hi,
         quantile_cont(deposit_per_m2_clean, 0.01) d_lo, quantile_cont(deposit_per_m2_clean, 0.99) d_hi
  from h3
),
w1 as (
  select h3.*,
    case when lh_vs_rent_median_ratio is not null then least(greatest(lh_vs_rent_median_ratio, a_lo), a_hi) end lh_vs_rent_median_ratio_winsor,
    case when lh_vs_sale_median_ratio is not null then least(greatest(lh_vs_sale_median_ratio, b_lo), b_hi) end lh_vs_sale_median_ratio_winsor,
    case when jeonse_to_sale_ratio_median is not null then least(greatest(jeonse_to_sale_ratio_median, c_lo), c_hi) end jeonse_to_sale_ratio_median_winsor,
    case when deposit_per_m2_clean is not null then least(greatest(deposit_per_m2_clean, d_lo), d_hi) end deposit_per_m2_clean_winsor
  from h3, wb
),
flagged as materialized (
  select *, ln(1 + lh_vs_rent_median_ratio_winsor) log1p_lh_vs_rent_median_ratio_winsor,
    ln(1 + lh_vs_sale_median_ratio_winsor) log1p_lh_vs_sale_median_ratio_winsor,
    ln(1 + jeonse_to_sale_ratio_median_winsor) log1p_jeonse_to_sale_ratio_median_winsor,
    ln(1 + deposit_per_m2_clean_winsor) log1p_deposit_per_m2_clean_winsor
  from w1
),
train_domain as (
  select * from flagged where is_in_domain_property_type and not is_exact_duplicate and not area_missing_or_zero
    and not area_too_small and not area_too_large and not sale_feature_missing
),
ood as (
  select * from flagged where is_ood_property_type and not is_exact_duplicate and not area_missing_or_zero
    and not area_too_small and not area_too_large
)
"""


def with_binding(body: str) -> str:
    return "with " + BINDING + body


def with_flagged(body: str) -> str:
    return "with " + BINDING + FLAGGED + body
