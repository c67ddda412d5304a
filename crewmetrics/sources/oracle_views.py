"""The adapter relations once more as DuckDB SQL, for the side-by-side check."""

VIEWS = {
    "workers": """
        select c_custkey as worker_id,
          (case c_nationkey when 3 then 'robot ' when 5 then 'auto ' when 12 then 'demo '
             when 13 then 'Test ' when 17 then 'Crew Bot ' when 21 then 'Freelance ' else '' end)
            || c_name as worker_name,
          case c_nationkey // 5 when 0 then 4 when 1 then 2 when 2 then 3 when 3 then 8 when 4 then 5
            end as office_id,
          c_nationkey as planning_group_id,
          case when c_mktsegment = 'HOUSEHOLD' then 1 when c_mktsegment <> 'BUILDING' then 0
            end as is_locked,
          'E' || cast(c_custkey as varchar) as employee_code,
          'w' || cast(c_custkey as varchar) || '@example.com' as email,
          case c_nationkey // 5 when 0 then 'Delta Office' when 1 then 'Metro Office'
            when 2 then 'Borough Office' when 3 then 'Canal Office' when 4 then 'Dock Office'
            end as office_name,
          date '2015-01-01' + c_nationkey * 30 as joined_date
        from customer""",
    "worker_roles": """
        select c_custkey as worker_id, case c_mktsegment when 'BUILDING' then 33
            when 'MACHINERY' then 5 else 3 end as role_id from customer
        union all select c_custkey, 8 from customer where c_mktsegment = 'FURNITURE'
        union all select c_custkey, 9 from customer where c_acctbal > 4000""",
    "offices": """
        select case r_regionkey when 0 then 4 when 1 then 2 when 2 then 3 when 3 then 8
            when 4 then 5 end as office_id,
          case r_regionkey when 0 then 'Delta Office' when 1 then 'Metro Office'
            when 2 then 'Borough Office' when 3 then 'Canal Office' when 4 then 'Dock Office'
            end as office_name
        from region""",
    "ev": """
        select event_id, ts, event_type, user_id // 10 as worker_id, user_id // 100 as leader_id,
          cast(regexp_extract(props, '[0-9]+') as int) as k, value,
          cast(floor(value) as bigint) as whole
        from events""",
    "activity_log": """
        select event_id, worker_id,
          case when k % 3 = 0 then event_id when k % 3 = 1 then 0 end as image_id,
          k % 2 as login_type_id,
          case when event_type = 'view'
                 then case k % 4 when 0 then 7 when 1 then 0 when 2 then 14 else 3 end
               when event_type = 'click'
                 then case k % 6 when 0 then 12 when 1 then 10 when 2 then 5 when 3 then 9
                        when 4 then 0 else 11 end
               when k >= 70 then 12 end as activity_type_id,
          case whole % 11 when 0 then 'Adobe Photoshop CC' when 1 then 'Google Chrome'
            when 2 then 'Skype for Business' when 3 then 'IDLE' when 4 then 'Windows Explorer'
            when 5 then 'Firefox' when 6 then 'smoothXpath' when 7 then 'Notepad++'
            when 8 then 'Brave Browser' when 9 then 'Solitaire' end as application_name,
          cast(floor(value * 1000) as bigint) as runtime_ms, ts as time_at
        from ev where event_type in ('view', 'click', 'error')""",
    "logout_requests": """
        select event_id, worker_id, ts as requested_at,
          case k % 4 when 0 then 1 when 1 then 6 when 2 then 7 end as reason_id
        from ev where event_type = 'signup'""",
    "meals": """
        select event_id, worker_id, ts as start_at, ts + whole * interval '1' minute as finish_at
        from ev where event_type = 'purchase'""",
    "shift_reports": """
        select worker_id, leader_id,
          cast(cast(ts + interval '45' minute as date) as timestamp)
            + (extract(hour from ts + interval '45' minute) // 8 * 480 + 375) * interval '1' minute
            as shift_start_local
        from ev where event_type = 'signup' and k % 4 = 1""",
    "skills": """
        select distinct case p_type when 'ECONOMY' then 121 when 'LARGE' then 5
            when 'MEDIUM' then 43 when 'PROMO' then 10 when 'SMALL' then 22
            when 'STANDARD' then 600 end as skill_id,
          p_type as skill_name,
          case when p_type = 'STANDARD' then 1 else 0 end as skill_kind_id,
          case p_type when 'ECONOMY' then 3 when 'LARGE' then 1 when 'MEDIUM' then 6
            when 'PROMO' then 2 when 'SMALL' then 5 when 'STANDARD' then 4 end as sort_order
        from part""",
    "lines": """
        select lineitem.*, skill_id, skill_name, l_suppkey // 10 as worker_id,
          l_shipdate + l_linenumber * interval '5' hour as assign_at
        from lineitem join part on p_partkey = l_partkey join skills on skill_name = p_type""",
    "steps": """
        select l_orderkey as image_id, l_linenumber as line_no, l_partkey as part_id,
          skill_id, skill_name, worker_id, assign_at,
          case when (l_orderkey + l_partkey) % 17 <> 0 then
            cast(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as bigint) // 1000 end
            as actual_s,
          case when (l_orderkey + l_partkey) % 17 <> 0 then
            cast(floor(l_extendedprice * (1 - l_discount) * (1 + l_tax)) as bigint) end as actual_ms,
          cast(floor(l_quantity * 1000) as bigint) as expected_ms,
          o_custkey as customer_id, 'Template ' || o_orderstatus as template_name
        from lines left join orders on o_orderkey = l_orderkey""",
    "rejections": """
        select l_orderkey as image_id, skill_id,
          case when l_partkey % 11 <> 0 then worker_id end as receiver_id,
          assign_at + cast(l_quantity as int) % 9 * interval '1' day as rejected_at,
          case l_linenumber % 3 when 0 then 1 when 1 then 0 end as is_customer
        from lines where l_returnflag = 'R'""",
    "images": "select o_orderkey as image_id from orders",
    "customers": "select c_custkey as customer_id, c_name as company from customer",
    "templates": """
        select c_custkey * 3 + pos as template_id, 'Template ' || kind as template_name,
          c_custkey as customer_id,
          case when c_acctbal < 0 and kind = 'P' then 1 else 0 end as is_deleted
        from customer, (values (0, 'F'), (1, 'O'), (2, 'P')) kinds(pos, kind)""",
    "work_reports": """
        select l_orderkey as image_id, skill_id, worker_id, l_shipdate as created_at,
          case when l_quantity >= 3 then 10 else 5 end as status_id
        from lines""",
    "mask_quality": """
        select l_orderkey as image_id, l_shipdate as created_at,
          case when l_returnflag = 'N' then 'Bad' else 'Good' end as grade
        from lineitem""",
}


def with_views(body: str) -> str:
    """Prefixes a query body, which may start with further CTEs, with the adapter CTEs."""
    ctes = ",\n".join(f"{name} as ({sql})" for name, sql in VIEWS.items())
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
