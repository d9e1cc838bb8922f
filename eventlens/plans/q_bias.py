"""Driver-bound queries: blindspot metrics, bias distribution, dominant side."""
from __future__ import annotations

from ..operators import bias
from ..sources.tables import DriverTables
from .registry import query

_SIDES_SQL = """
sides AS (
  select l.cluster_id,
    case when s.bias is null or s.bias = '' then null
         when contains(lower(s.bias), 'pro') then 'pro'
         when contains(lower(s.bias), 'oppose') then 'oppose'
         else 'neutral' end as side
  from v_links l join v_articles a on a.id = l.article_id
  left join v_sources s on s.id = a.source_id),
counts AS (
  select cluster_id,
    count(*) filter (where side = 'pro') as pro_count,
    count(*) filter (where side = 'neutral') as neutral_count,
    count(*) filter (where side = 'oppose') as oppose_count,
    count(*) as total_articles
  from sides group by cluster_id)
"""


@query("blindspot_report", """
WITH """ + _SIDES_SQL + """,
p AS (
  select *, pro_count + neutral_count + oppose_count as total_rated,
    pro_count / (pro_count + neutral_count + oppose_count) * 100 as pp,
    neutral_count / (pro_count + neutral_count + oppose_count) * 100 as pn,
    oppose_count / (pro_count + neutral_count + oppose_count) * 100 as po
  from counts where pro_count + neutral_count + oppose_count > 0)
select cluster_id, pro_count, neutral_count, oppose_count, total_rated,
  case when po > 70 and pp < 15 then 'PRO_SAF_BLINDSPOT'
       when pp > 70 and po < 15 then 'OPPOSE_SAF_BLINDSPOT'
       when pn > 80 and total_rated > 2 then 'NEUTRAL_ONLY'
       when pn < 20 and total_rated > 3 then 'PARTISAN_STORY'
       else 'BALANCED' end as blindspot_type,
  round_even(greatest(0.0::DOUBLE, 1 - ((abs(pp - 33.33::DOUBLE) + abs(pn - 33.33::DOUBLE))
    + abs(po - 33.33::DOUBLE)) / 100), 2) as balance_score
from p
""")
def blindspot_report(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return bias.blindspot_metrics(t.links, t.articles, t.sources)


_DIST_SQL = """
dist AS (
  select cluster_id, total_articles,
    pro_count, case when total_articles > 0 then round_even(pro_count / total_articles * 100, 1) else 0.0 end as pro_pct,
    neutral_count, case when total_articles > 0 then round_even(neutral_count / total_articles * 100, 1) else 0.0 end as neutral_pct,
    oppose_count, case when total_articles > 0 then round_even(oppose_count / total_articles * 100, 1) else 0.0 end as oppose_pct
  from counts)
"""


@query("bias_distribution", "WITH " + _SIDES_SQL + "," + _DIST_SQL + " select * from dist")
def bias_distribution(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return bias.bias_distribution(t.links, t.articles, t.sources)


@query("dominant_side", "WITH " + _SIDES_SQL + "," + _DIST_SQL + """
select cluster_id,
  case when pro_pct >= neutral_pct and pro_pct >= oppose_pct then 'مؤيد'
       when neutral_pct >= oppose_pct then 'محايد' else 'معارض' end as dominant_label,
  cast(round_even(case when pro_pct >= neutral_pct and pro_pct >= oppose_pct then pro_pct
       when neutral_pct >= oppose_pct then neutral_pct else oppose_pct end, 0) as BIGINT) as dominant_pct
from dist
""")
def dominant_side(spark, sf_dir):
    t = DriverTables(spark, sf_dir)
    return bias.dominant_side(bias.bias_distribution(t.links, t.articles, t.sources))
