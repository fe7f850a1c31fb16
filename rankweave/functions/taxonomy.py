"""Competitions: league, tier, region and tournament of an event, as column expressions over rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ratings import lookup
from .rules import ANY_CASE, bound, first_rule

#: Tiers of leagues, with their prior ratings, the highest effective rating (null: none), and the score of a profile.
TIER_PRIORS = {"tier-one": 1500.0, "tier-two": 1450.0, "tier-three": 1375.0, "emerging": 1300.0, "unknown": 1250.0}
TIER_CAPS = {"emerging": 1375.0, "unknown": 1250.0}
PROFILE_SCORES = {"tier-one": 5, "tier-two": 4, "tier-three": 3, "emerging": 2, "unknown": 1}
LEAGUES_BY_TIER = {
    "tier-one": ("LCK", "LPL"),
    "tier-two": ("LEC", "LCS", "LTA", "LTA N", "LCP"),
    "tier-three": ("LTA S", "CBLOL", "VCS", "PCS", "LJL", "LLA", "LCO"),
    "emerging": ("TCL", "NACL", "LCKC", "LCK CL", "LAS", "LFL", "LFL2", "NLC", "NL", "PRM", "PRMP", "LVP SL", "LES", "LIT", "RL", "NEXO", "CCWS", "HC", "IC", "EM", "EMEA MASTERS", "AL", "HM", "HW", "HLL", "EBL", "LPLOL", "CD", "ROL", "LRN", "LRS", "LTS", "CT"),
}
EMERGING_WORDS = r"\bacademy\b|\bchallengers?\b|\bdevelopment\b|\bdivision\s*2\b|\bd2\b|\belite\b|\bnational\b|\bproving grounds\b|\bsecondary\b"
CONNECTIVITY = 8.0
#: Leagues whose teams are rated, and those that feed one of them.
RATED = ("LCS", "CBLOL", "LEC", "LCK", "LPL", "LCP")
FEEDERS, FEEDER_REGIONS, FEEDER_TARGET = ("PCS", "VCS", "LJL", "LCO", "LTS"), ("PCS", "VCS"), "LCP"
REGIONS = ("LCK", "LPL", "LEC", "LCS", "LCP", "CBLOL", "VCS", "PCS", "International")
#: League by words of an event's name, whatever the case; the first rule that fits counts.
LEAGUE_RULES = (
    ("Worlds", r"\bworld championship\b|\bworlds\b|\bwlds?\b"),
    ("MSI", r"\bmid-season invitational\b|\bmsi\b"),
    ("FST", r"\bfirst\s+stand\b|\bfst\s+\d{4}\b"),
    ("EWC", r"\besports\s+world\s+cup\b|\bewc\s+\d{4}\b"),
    ("Asia Master", r"\basia\s+masters?\b"),
    ("KeSPA", r"\bkespa\b"),
    ("DCup", r"\bdcup\b|\bdemacia cup\b"),
    ("EMEA Masters", r"\bemea masters\b|\bem\s+\d{4}\b"),
    ("LCK Academy", r"\blck\s+academy\b|\blas\s+\d{4}\b"),
    ("LCK CL", r"\blck\s*cl\b|\blckc\b|\blck\s+challengers?\b"),
    ("LTA N", r"\blta\s+n(?:orth)?\b"),
    ("LTA S", r"\blta\s+s(?:outh)?\b"),
    ("NACL", r"\bnacl\b|\bnorth american challengers league\b"),
    ("LVP SL", r"\blvp\s+sl\b|\bsuperliga(?:\s+domino's)?\b"),
    ("PRM", r"\bprime league\b|\bprm\b"),
    ("LES", r"\bles\b|\besports\s+series\s+madrid\b"),
    ("LIT", r"\blit\b"),
    ("EBL", r"\bebl\b|\bbalkan\b"),
    ("HLL", r"\bhll\b|\bhellenic\s+legends\b"),
    ("HC", r"\bhc\b|\bhellenic\s+challengers?\s+cup\b"),
    ("LPLOL", r"\blplol\b"),
    ("RL", r"\brl\b|\brift\s+legends\b"),
    ("NEXO", r"\bnexo\b|\bnexus\s+tour\b"),
    ("NL", r"\bnexus\s+league\b|\bnl\s+\d{4}\b"),
    ("CCWS", r"\bccws\b|\bcomedy\s+central\s+winter\s+snowdown\b"),
    ("CT", r"\bcircuito\s+tormenta\b|\bct\s+\d{4}\b"),
    ("IC", r"\bic\s+\d{4}\b|\biberian\s+cup\b"),
    ("HW", r"\bhitpoint\s+winter\b|\bhw\s+\d{4}\b"),
    ("HM", r"\bhitpoint\b|\bhm\s+\d{4}\b"),
    ("AL", r"\barabian league\b|\bal\s+\d{4}\b"),
    ("ROL", r"\broad of legends\b|\brol\s+\d{4}\b"),
    ("CD", r"\bcircuito desafiante\b|\bcd\s+\d{4}\b"),
    ("LRN", r"\blrn\b|\bliga\s+regional\s+norte\b"),
    ("LRS", r"\blrs\b|\bliga\s+regional\s+sur\b"),
    ("LTS", r"\blts\b"),
    ("LCK", r"\blck\b"),
    ("LPL", r"\blpl\b"),
    ("LEC", r"\blec\b"),
    ("LCS", r"\blcs\b"),
    ("LTA", r"\blta\b"),
    ("LCP", r"\blcp\b"),
    ("CBLOL", r"\bcblol\b"),
    ("VCS", r"\bvcs\b"),
    ("PCS", r"\bpcs\b"),
    ("LLA", r"\blla\b"),
    ("TCL", r"\btcl\b"),
    ("LJL", r"\bljl\b"),
    ("LCO", r"\blco\b"),
    ("NLC", r"\bnlc\b"),
    ("LFL2", r"\blfl2\b|\blfl\s+division\s*2\b"),
    ("LFL", r"\blfl\b"),
)
#: Event tier in playoffs and otherwise by words of league and event, in lower case; the first rule that fits counts.
TIER_RULES = (
    (r"academic esports world tournament|university esports", "qualifier", "qualifier"),
    (r"online qualifiers?", "qualifier", "qualifier"),
    (r"\bdcup\b|demacia cup", "major-playoffs", "regional-regular"),
    (r"first stand|\bfst\b", "msi-bracket", "msi-bracket"),
    (r"emea masters|\bem\b|minor|\bewc\b|esports world cup|asia master|\basi\b|\bac\b|kespa", "minor-international", "minor-international"),
    (r"\bwlds?\b|world", "worlds-playoffs", "worlds-main"),
    (r"msi", "msi-bracket", "msi-play-in"),
)
INTERNATIONAL_LEAGUES = ("MSI", "WORLDS", "WORLD", "WLD", "WLDS", "FST", "EWC")
TIER_RANKS = {"qualifier": 0, "regional-regular": 1, "major-playoffs": 2, "minor-international": 3, "msi-play-in": 4, "worlds-main": 5, "msi-bracket": 6, "worlds-playoffs": 7}
#: Region by whole league code, then by parts of it.
REGION_CODES = (
    ("LEC", ("AL", "CCWS", "CT", "EBL", "EM", "HC", "HLL", "HM", "HW", "IC", "LES", "LFL2", "LIT", "LPLOL", "NEXO", "NL", "PRMP", "RL", "ROL")),
    ("CBLOL", ("CD", "LRN", "LRS")),
    ("LCP", ("LTS",)),
)
REGION_PARTS = (
    ("LCK", ("LCK", "LAS")),
    ("LPL", ("LPL", "DCUP", "DEMACIA CUP")),
    ("LEC", ("LEC", "EMEA", "LFL", "NLC", "PRM", "LVP", "SUPERLIGA", "TCL", "ARABIAN", "HITPOINT", "ROAD OF LEGENDS")),
    ("LCS", ("LCS", "LTA N", "LTA NORTH", "NACL")),
    ("LCP", ("LCP", "LJL", "LCO")),
    ("CBLOL", ("CBLOL", "LTA S", "LTA SOUTH", "LLA", "CIRCUITO DESAFIANTE")),
    ("VCS", ("VCS",)),
    ("PCS", ("PCS",)),
)
#: Tournament families by words, and words that rule one out.
FAMILIES = (
    ("first-stand", r"\b(?:fst|first stand)\b", ""),
    ("msi", r"\b(?:msi|mid-season invitational)\b", r"\broad to msi\b"),
    ("worlds", r"\b(?:worlds|wlds|world championship)\b", ""),
    ("ewc", r"\b(?:ewc|esports world cup)\b", r"\b(?:online\s+)?qualifiers?\b"),
)
NOT_MAIN = r"\b(?:online\s+)?qualifiers?\b|\bregional finals?\b|\broad to\b"
DEVELOPMENT = r"\b(?:academy|challengers?|youth)\b"
#: A league's code at the start of an event, before a year, a slash or the end.
LEADING_LEAGUE = "^(" + "|".join(sorted((x for own in LEAGUES_BY_TIER.values() for x in own), key=lambda x: (-len(x), x))) + r")(?:\s+\d{4}\b|/|\s*$)"


def any_case(pattern: str) -> str:
    return f"{ANY_CASE}{pattern}"


def code(league: Column) -> Column:
    """A league's name as codes are compared: trimmed and in upper case."""
    return F.upper(F.trim(league))


def league_of_event(event: Column) -> Column:
    """The league of an event: a regional league's code at its start, else the first rule that fits, else ``Unknown``."""
    text = F.coalesce(event, F.lit(""))
    rules = [(league, any_case(p)) for league, p in LEAGUE_RULES]
    ruled = lambda low: first_rule(text, rules, "Unknown", low)
    explicit = F.regexp_extract(code(text), LEADING_LEAGUE, 1)
    return bound(explicit, lambda own: F.when(own != "", own).otherwise(bound(F.lower(text), ruled)))


def event_tier(event: Column, league: Column | None = None, playoffs: Column | None = None) -> Column:
    """The event tier from league and event, and whether it is playoffs (null: not)."""
    league = F.lit("") if league is None else F.coalesce(league, F.lit(""))
    in_playoffs = F.lit(False) if playoffs is None else F.coalesce(playoffs, F.lit(False))
    text = F.lower(F.concat_ws(" ", league, F.coalesce(event, F.lit(""))))
    either = lambda high, low: F.when(in_playoffs, high).otherwise(low)
    road = ("major-playoffs", "road to msi", ~code(league).isin(*INTERNATIONAL_LEAGUES))
    return first_rule(text, [road, *[(either(high, low), pattern) for pattern, high, low in TIER_RULES]], either("major-playoffs", "regional-regular"))


def tier_rank(tier: Column) -> Column:
    return lookup(TIER_RANKS, tier, None).cast("int")


def league_tier(league: Column) -> Column:
    own = code(F.coalesce(league, F.lit("")))
    out = F.when(league.rlike(any_case(EMERGING_WORDS)), "emerging").otherwise("unknown")
    for tier, leagues in reversed(LEAGUES_BY_TIER.items()):
        out = F.when(own.isin(*leagues), tier).otherwise(out)
    return F.when(own.isin("", "UNKNOWN"), "unknown").otherwise(out)


def league_prior(league: Column) -> Column:
    return lookup(TIER_PRIORS, league_tier(league), 1250.0)


def capped_league_rating(league: Column, rating: Column) -> Column:
    return F.least(rating, lookup(TIER_CAPS, league_tier(league), float("inf")))


def effective_league_rating(league: Column, raw: Column, abroad: Column) -> Column:
    """A league's rating drawn to its prior by the number of its games abroad, and capped by its tier."""
    prior = league_prior(league)
    return capped_league_rating(league, prior + abroad / (abroad + CONNECTIVITY) * (raw - prior))


def region_of_league(league: Column) -> Column:
    own = code(F.coalesce(league, F.lit("")))
    out = first_rule(own, [(region, "|".join(parts)) for region, parts in REGION_PARTS], "International")
    for region, codes in reversed(REGION_CODES):
        out = F.when(own.isin(*codes), region).otherwise(out)
    return out


def current_region(league: Column, fallback: Column) -> Column:
    """The region whose top league a league belongs to now: feeders count for the one they feed."""
    fed = code(F.coalesce(league, F.lit(""))).isin(*FEEDERS) | code(F.coalesce(fallback, F.lit(""))).isin(*FEEDER_REGIONS)
    return F.when(fed, FEEDER_TARGET).otherwise(F.coalesce(fallback, F.lit("International")))


def is_rated_league(league: Column) -> Column:
    return code(F.coalesce(league, F.lit(""))).isin(*RATED)


def _given(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def home_league(explicit_home: Column, explicit: Column, competition: Column, identity: Column, unknown: str = "Unknown") -> Column:
    """The first given of an explicit home league, an explicit league and a competition that is a league; else, for an unknown competition, the team's identity."""
    played = F.coalesce(_given(competition), F.lit(unknown))
    is_league = code(played) != "UNKNOWN"
    return F.coalesce(_given(explicit_home), _given(explicit), F.when(is_league, played).otherwise(F.coalesce(_given(identity), F.lit(unknown))))


def side_region(explicit: Column, league: Column, identity: Column, missing: Column) -> Column:
    """The region of a side: a known explicit one, that of its home league, else its identity's."""
    known = F.when(explicit.isin(*REGIONS), explicit)
    of_league = F.when(code(league) == "UNKNOWN", "International").otherwise(region_of_league(league))
    return F.coalesce(known, F.when(_given(league).isNotNull(), of_league), identity, missing)


def tournament_family(event: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, pattern, without in reversed(FAMILIES):
        fits = event.rlike(any_case(pattern))
        if without:
            fits = fits & ~event.rlike(any_case(without))
        out = F.when(fits, family).otherwise(out)
    return out


def tournament_season(event: Column, fallback: Column) -> Column:
    named = F.nullif(F.regexp_extract(event, r"\b(20\d{2})\b", 1), F.lit(""))
    text = fallback.cast("string")
    return F.coalesce(named, F.when(text.rlike(r"^20\d{2}$"), text))


def tournament_id(event: Column, fallback: Column) -> Column:
    """``family:season`` of an international tournament; null for other events."""
    family, season = tournament_family(event), tournament_season(event, fallback)
    return F.when(family.isNotNull() & season.isNotNull(), F.concat_ws(":", family, season))


def is_main_event(event: Column, phase: Column, tier: Column) -> Column:
    """Whether a match counts for its tournament's span: no qualifier, regional final or road to it."""
    return F.coalesce(tier != "qualifier", F.lit(True)) & ~F.concat_ws(" ", event, phase).rlike(any_case(NOT_MAIN))


def is_development_team(name: Column) -> Column:
    return F.coalesce(name.rlike(any_case(DEVELOPMENT)), F.lit(False))
