"""SQL twin of the encounter fold: a recursive query that takes one row of every log at a time."""

# ``clean`` is the table of classified events; default settings, no zones.
FOLD = """marks as (select distinct log_id, ts from split_markers where kind = 0),
last_ts as (select log_id, max(ts) as t from clean group by 1),
seq as (select *, row_number() over (partition by log_id order by sec, o, line_no) as i from (
 select log_id, cast(epoch(ts) as bigint) as sec, 1 as o, line_no, action, attacker, target, attacker_kind as ak, target_kind as tk, amount, mechanic from clean
 union all select m.log_id, cast(epoch(m.ts) as bigint), 0, null, 'split', null, null, null, null, 0, null from marks m join last_ts l on m.log_id = l.log_id and m.ts <= l.t)),
fold as (
 select distinct log_id, cast(0 as bigint) as i, false as open, 0 as no, 0 as started, cast(null as bigint) as a, cast(null as bigint) as b, cast(null as bigint) as act,
  cast([] as struct(k varchar, v bigint)[]) as dmg, cast([] as varchar[]) as dead, cast([] as varchar[]) as fallen, false as sealed, cast(null as bigint) as mercy,
  cast(null as struct(no integer, a bigint, b bigint, act bigint, why varchar, dmg struct(k varchar, v bigint)[], dead varchar[], fallen varchar[])) as kept,
  cast(null as struct(no integer, a bigint, b bigint, act bigint, why varchar, dmg struct(k varchar, v bigint)[], dead varchar[], fallen varchar[])) as told
 from seq
 union all
 select log_id, i, open and why3 is null, no, started, a, b, act, dmg, dead, fallen, sealed,
  case when action = 'split' then null when open and action = 'death' and tk = 'player' and target = lower(split_part(log_id, '_', 1)) then sec + 180 else mercy end,
  case when why3 is not null then struct_pack(no := no, a := a, b := sec, act := act, why := why3, dmg := dmg, dead := dead, fallen := fallen) else kept end,
  case when why3 is not null then struct_pack(no := no, a := a, b := sec, act := act, why := why3, dmg := dmg, dead := dead, fallen := fallen) else told end
 from (
  select *, case when open and action = 'death' and tk = 'npc' and target is not null and len(list_filter(dmg, lambda d: d.v > 0 and not list_contains(dead, d.k))) = 0 then 'all_mobs_dead' end as why3
  from (
   select log_id, i, sec, action, tk, target, open, no, started, a, case when open and (blow or action in ('heal', 'death')) then greatest(b, sec) else b end as b, case when open and blow then sec else act end as act, sealed, mercy, kept, told,
    case when not open or npc is null or not (blow or action = 'death') then dmg when len(list_filter(dmg, lambda d: d.k = npc)) > 0 then list_transform(dmg, lambda d: case when d.k = npc then struct_pack(k := d.k, v := d.v + gain) else d end) else list_append(dmg, struct_pack(k := npc, v := gain)) end as dmg,
    case when open and action = 'death' and tk = 'npc' and target is not null and not list_contains(dead, target) then list_append(dead, target) else dead end as dead,
    case when open and action = 'death' and tk = 'player' and target is not null then list_append(fallen, target) else fallen end as fallen
   from (
    select log_id, i, sec, action, tk, target, blow, mercy, kept, told, npc, gain,
     open or blow as open, sealed and not blow as sealed,
     case when not open and blow and not again then started + 1 else started end as started,
     case when not open and blow then case when again then kept.no else started + 1 end else no end as no,
     case when not open and blow then case when again then kept.a else sec end else a end as a,
     case when not open and blow then case when again then kept.b else sec end else b end as b,
     case when not open and blow then case when again then kept.act else sec end else act end as act,
     case when not open and blow then case when again then kept.dmg else [] end else dmg end as dmg,
     case when not open and blow then case when again then kept.dead else [] end else dead end as dead,
     case when not open and blow then case when again then kept.fallen else [] end else fallen end as fallen
    from (
     select *, not sealed and kept is not null and kept.why = 'all_mobs_dead' and sec - kept.b <= 12 as again
     from (
      select log_id, i, sec, action, tk, target, mercy, npc, gain, blow, started, no, a, b, act, dmg, dead, fallen,
       open and why is null as open, sealed or action = 'split' as sealed,
       case when why is not null and (len(dead) > 0 or end_s - a >= 3) then struct_pack(no := no, a := a, b := end_s, act := act, why := why, dmg := dmg, dead := dead, fallen := fallen) else kept end as kept,
       case when why is not null and (len(dead) > 0 or end_s - a >= 3) then struct_pack(no := no, a := a, b := end_s, act := act, why := why, dmg := dmg, dead := dead, fallen := fallen) end as told
      from (
       select *, case why when 'manual' then greatest(sec, act) when 'time_cap' then sec when 'idle' then greatest(act, a) end as end_s
       from (
        select s.log_id, s.i, s.sec, s.action, s.tk, s.target, f.open, f.no, f.started, f.a, f.b, f.act, f.dmg, f.dead, f.fallen, f.sealed, f.mercy, f.kept,
         coalesce(s.action in ('damage', 'miss') and ((s.tk = 'npc' and (coalesce(s.ak in ('player', 'pet'), false) or coalesce(s.mechanic = 'damage_shield', false))) or (s.ak = 'npc' and s.tk in ('player', 'pet'))), false) as blow,
         case when s.action in ('damage', 'miss') then case when s.tk = 'npc' then s.target else s.attacker end when s.action = 'death' and s.tk = 'npc' then s.target end as npc,
         case when s.action = 'damage' and s.tk = 'npc' then s.amount else 0 end as gain,
         case when not f.open then null when s.action = 'split' then 'manual' when s.sec - f.act > case when f.mercy is not null and s.sec <= f.mercy then 180 else 45 end then 'idle' when s.sec - f.a >= 600 then 'time_cap' end as why
        from fold f join seq s on s.log_id = f.log_id and s.i = f.i + 1
       )))))))),
ends as (select log_id, struct_pack(no := no, a := a, b := greatest(act, a), act := act, why := 'log_end', dmg := dmg, dead := dead, fallen := fallen) as told, i from fold where open and (len(dead) > 0 or greatest(act, a) - a >= 3) qualify i = max(i) over (partition by log_id)),
tails as (select e.* from ends e join (select log_id, max(i) as i from seq group by 1) t on t.log_id = e.log_id and t.i = e.i),
told as (select log_id, told, i from fold where told is not null union all select log_id, told, i + 1 from tails),
final as (select log_id, told as t from told qualify row_number() over (partition by log_id, told.no order by i desc) = 1)
"""
HEADERS = """select log_id, t.no as enc_id, make_timestamp(t.a * 1000000) as start_ts, make_timestamp(t.b * 1000000) as end_ts, make_timestamp(t.act * 1000000) as last_activity, cast(null as varchar) as zone, t.why as end_reason,
 case when len(t.dmg) = 0 then 'Unknown' else list_filter(t.dmg, lambda d: d.v = list_max(list_transform(t.dmg, lambda x: x.v)))[1].k || case when len(t.dmg) > 1 then ' +' || (len(t.dmg) - 1) else '' end end as title,
 greatest(1.0, cast(t.b - t.a as double)) as duration_s, '{' || coalesce(list_aggregate(list_transform(t.dmg, lambda d: '"' || d.k || '":' || d.v), 'string_agg', ','), '') || '}' as npc_damage,
 coalesce(list_aggregate(t.dead, 'string_agg', '|'), '') as npcs_killed, coalesce(list_aggregate(t.fallen, 'string_agg', '|'), '') as player_deaths from final"""
