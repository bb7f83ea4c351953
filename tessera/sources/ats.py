"""Boards of applicant-tracking systems, by platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.boards import Board, blocks, few, joined, plain, postings, says, tag, truthy

_HOME = r"remote|home\s*office"

BOARDS: dict[str, Board] = {
    "greenhouse": Board(
        "gh", "b.jobs", schema="jobs array<struct<id:string,absolute_url:string,title:string,location:struct<name:string>,content:string,updated_at:string>>", titled=False,
        fields={"external_id": "j.id", "url": "j.absolute_url", "title": "j.title", "location": "j.location.name", "remote": says("j.location.name"), "description": "j.content", "posted_at": "j.updated_at"},
    ),
    "lever": Board(
        "lever", "b", schema="array<struct<id:string,hostedUrl:string,text:string,categories:struct<location:string>,workplaceType:string,descriptionPlain:string,description:string,createdAt:string>>", html=(), titled=False,
        fields={"external_id": "j.id", "url": "j.hostedUrl", "title": "j.text", "location": "j.categories.location", "remote": says("j.categories.location", "j.workplaceType"),
                "work_mode": "case when j.workplaceType in ('remote', 'hybrid', 'onsite') then j.workplaceType end", "description": f"coalesce(j.descriptionPlain, {plain('j.description')})", "posted_at": "j.createdAt"},
    ),
    "ashby": Board(
        "ashby", "b.jobs", schema="jobs array<struct<id:string,jobUrl:string,applyUrl:string,title:string,location:string,locationName:string,isRemote:string,descriptionPlain:string,descriptionHtml:string,description:string,publishedAt:string>>", html=(), titled=False,
        fields={"external_id": "coalesce(j.id, j.jobUrl)", "url": "coalesce(j.jobUrl, j.applyUrl)", "title": "j.title", "location": "coalesce(j.location, j.locationName)", "remote": f"{truthy('j.isRemote')} or {says('j.location')}",
                "description": f"coalesce(j.descriptionPlain, {plain('coalesce(j.descriptionHtml, j.description)')})", "posted_at": "j.publishedAt"},
    ),
    "smartrecruiters": Board(
        "sr", "b.content", schema="content array<struct<id:string,name:string,location:struct<city:string,country:string,remote:string>,releasedDate:string>>", html=(),
        fields={"external_id": "j.id", "url": "concat('https://jobs.smartrecruiters.com/', token, '/', j.id)", "title": "j.name", "location": joined("j.location.city", "j.location.country"), "remote": truthy("j.location.remote"), "posted_at": "j.releasedDate"},
    ),
    "workable": Board(
        "workable", "transform(b.jobs, x -> struct(b.name as board, x as job))", schema="name string, jobs array<struct<shortcode:string,code:string,url:string,application_url:string,title:string,city:string,country:string,telecommuting:string,published_on:string>>", html=(),
        fields={"external_id": "coalesce(j.job.shortcode, j.job.code, j.job.url)", "url": "coalesce(j.job.url, j.job.application_url)", "title": "j.job.title", "company": "coalesce(nullif(j.board, ''), company)",
                "location": joined("j.job.city", "j.job.country"), "remote": truthy("j.job.telecommuting"), "posted_at": "j.job.published_on"},
    ),
    "recruitee": Board(
        "recruitee", "b.offers", schema="offers array<struct<id:string,guid:string,careers_url:string,title:string,company_name:string,city:string,country:string,remote:string,hybrid:string,description:string,published_at:string,created_at:string>>",
        fields={"external_id": "coalesce(j.id, j.guid)", "url": "j.careers_url", "title": "j.title", "company": "coalesce(nullif(j.company_name, ''), company)", "location": joined("j.city", "j.country"), "remote": truthy("j.remote"),
                "work_mode": f"case when {truthy('j.remote')} then 'remote' when {truthy('j.hybrid')} then 'hybrid' end", "description": "j.description", "posted_at": "coalesce(nullif(j.published_at, ''), j.created_at)"},
    ),
    "personio": Board(
        "personio", blocks("position"), wanted=f"{tag('id')} <> ''", html=("description", "title", "company", "location"),
        fields={"external_id": tag("id"), "url": f"concat('https://', token, '.jobs.personio.com/job/', {tag('id')})", "title": tag("name"), "company": f"coalesce(nullif({tag('subcompany')}, ''), company)", "location": tag("office"),
                "remote": says(tag("office"), tag("schedule"), tag("name"), word=_HOME), "description": r"array_join(regexp_extract_all(j, r'(?is)<value>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</value>', 1), ' ')", "posted_at": tag("createdAt")},
    ),
    "workday": Board(
        "workday", "b.jobPostings", schema="total int, jobPostings array<struct<bulletFields:array<string>,externalPath:string,title:string,locationsText:string,postedOn:string>>", html=(),
        fields={"external_id": "coalesce(get(j.bulletFields, 0), j.externalPath, '')", "url": r"concat(regexp_replace(token, r'^([^@]+)@(wd\d+)/(.+)$', 'https://$1.$2.myworkdayjobs.com/$3'), coalesce(j.externalPath, ''))",
                "title": "j.title", "location": "j.locationsText", "remote": says("j.locationsText", "j.title"), "posted_at": "j.postedOn"},
    ),
    "teamtailor": Board(
        "teamtailor", blocks("item"), wanted=f"{tag('link')} <> '' and {tag('title')} <> ''", html=("description", "title", "location"), titled=False,
        fields={"external_id": f"element_at(filter(split({tag('link')}, '/'), x -> x <> ''), -1)", "url": tag("link"), "title": tag("title"), "location": tag("tt:location", "location", "tt:city"), "remote": says(tag("title")), "description": tag("description"), "posted_at": tag("pubDate")},
    ),
    "bamboohr": Board(
        "bamboohr", "b.result", schema="result array<struct<id:string,jobOpeningName:string,location:struct<city:string,state:string>,isRemote:string>>", wanted="j.jobOpeningName <> '' and trim(j.id) <> ''", html=(),
        fields={"external_id": "j.id", "url": "concat('https://', token, '.bamboohr.com/careers/', url_encode(j.id))", "title": "j.jobOpeningName", "location": joined("j.location.city", "j.location.state"), "remote": truthy("j.isRemote")},
    ),
    "breezy": Board(
        "breezy", "b", schema="array<struct<name:string,url:string,location:struct<name:string,city:string,state:string,country:struct<name:string>,is_remote:string>,published_date:string>>", wanted="j.name <> '' and j.url like 'https://%'", html=(),
        fields={"external_id": "element_at(filter(split(j.url, '/'), x -> x <> ''), -1)", "url": "j.url", "title": "j.name", "location": f"coalesce(nullif(trim(j.location.name), ''), {joined('j.location.city', 'j.location.state', 'j.location.country.name')})",
                "remote": truthy("j.location.is_remote"), "posted_at": "j.published_date"},
    ),
    "join": Board(
        "join", r"""transform(from_json(regexp_extract(b, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), 'props struct<pageProps:struct<initialState:struct<company:struct<domain:string>,jobs:struct<items:array<struct<title:string,idParam:string,city:struct<cityName:string>>>>>>>').props.pageProps.initialState.jobs.items,
            x -> struct(x as job, regexp_extract(b, r'"company"\s*:\s*\{[^{}]*"domain"\s*:\s*"([^"]+)"', 1) as domain))""", wanted="j.job.title <> '' and j.job.idParam <> ''", html=(),
        fields={"external_id": "j.job.idParam", "url": "concat('https://join.com/companies/', coalesce(nullif(j.domain, ''), token), '/jobs/', j.job.idParam)", "title": "j.job.title", "location": "j.job.city.cityName", "remote": says("j.job.title")},
    ),
    "pinpoint": Board(
        "pinpoint", "b.data", schema="data array<struct<id:string,url:string,title:string,location:struct<name:string,city:string,province:string>,workplace_type:string,compensation:string,description:string>>", wanted="j.title <> '' and j.url like 'https://%'",
        fields={"external_id": "coalesce(j.id, j.url)", "url": "j.url", "title": "j.title", "location": f"coalesce(nullif(trim(j.location.name), ''), {joined('j.location.city', 'j.location.province')})", "remote": says("j.workplace_type", "j.location.name"), "salary_text": "j.compensation", "description": "j.description"},
    ),
    "oracle": Board(
        "oracle", "get(b.items, 0).requisitionList", schema="items array<struct<TotalJobsCount:string,requisitionList:array<struct<Id:string,Title:string,PrimaryLocation:string,secondaryLocations:array<struct<Name:string>>,WorkplaceType:string,ShortDescriptionStr:string,ExternalQualificationsStr:string,ExternalResponsibilitiesStr:string,PostedDate:string>>>>",
        wanted="j.Id <> '' and j.Title <> ''", html=(),
        fields={"external_id": "j.Id", "url": r"concat('https://', regexp_extract(token, '^([^@]+)@', 1), '.oraclecloud.com/hcmUI/CandidateExperience/en/sites/', regexp_extract(token, '@(.+)$', 1), '/job/', j.Id)", "title": "j.Title",
                "location": joined("j.PrimaryLocation", "array_join(filter(j.secondaryLocations.Name, x -> x <> ''), '; ')", by="; "), "remote": says("j.WorkplaceType", "j.PrimaryLocation"),
                "description": joined(*(plain(f"j.{c}") for c in ("ShortDescriptionStr", "ExternalQualificationsStr", "ExternalResponsibilitiesStr")), by="\\n"), "posted_at": "j.PostedDate"},
    ),
    "beesite": Board(
        "beesite", "transform(b.SearchResult.SearchResultItems, x -> x.MatchedObjectDescriptor)", schema="SearchResult struct<SearchResultItems:array<struct<MatchedObjectDescriptor:struct<PositionID:string,PositionTitle:string,PositionURI:string,PositionLocation:string,PublicationStartDate:string>>>>",
        wanted="j.PositionID <> '' and j.PositionTitle <> ''", html=(),
        fields={"external_id": "j.PositionID", "url": "j.PositionURI", "title": "j.PositionTitle", "location": (_B := "array_join(filter(transform(from_json(case when j.PositionLocation like '{%' then concat('[', j.PositionLocation, ']') else j.PositionLocation end, 'array<struct<CityName:string,CountryName:string>>'), l -> concat_ws(', ', nullif(l.CityName, ''), nullif(l.CountryName, ''))), x -> x <> ''), '; ')"),
                "remote": says("j.PositionTitle", _B, word=_HOME), "posted_at": "j.PublicationStartDate"},
    ),
    "successfactors": Board(
        "sf", "transform(b.jobSearchResult, x -> coalesce(x.response, struct(x.id, x.unifiedUrlTitle, x.unifiedStandardTitle, x.unifiedStandardStart, x.jobLocationShort)))",
        schema="jobSearchResult array<struct<response:struct<id:string,unifiedUrlTitle:string,unifiedStandardTitle:string,unifiedStandardStart:string,jobLocationShort:array<string>>,id:string,unifiedUrlTitle:string,unifiedStandardTitle:string,unifiedStandardStart:string,jobLocationShort:array<string>>>",
        wanted="j.id <> ''", keep="first", html=(),
        fields={"external_id": "j.id", "url": "concat('https://', token, '/job/', coalesce(j.unifiedUrlTitle, j.id), '/', j.id, '-', region)", "title": "j.unifiedStandardTitle", "location": "array_join(filter(j.jobLocationShort, x -> x <> ''), '; ')",
                "remote": says("j.unifiedStandardTitle", "array_join(j.jobLocationShort, '; ')", word=_HOME), "posted_at": "j.unifiedStandardStart"},
    ),
    "eightfold": Board(
        "eightfold", "b.positions", schema="positions array<struct<id:string,name:string,location:string,locations:array<string>,canonicalPositionUrl:string,job_description:string,t_create:string>>", wanted="j.id <> '' and j.name <> ''",
        fields={"external_id": "j.id", "url": "coalesce(j.canonicalPositionUrl, concat('https://', token, '.eightfold.ai/careers/job/', j.id))", "title": "j.name", "location": few("concat(array(j.location), coalesce(j.locations, array()))"),
                "remote": says("j.location", "array_join(j.locations, ' ')"), "description": "j.job_description", "posted_at": "j.t_create"},
    ),
    "jibe": Board(
        "jibe", "transform(b.jobs, x -> coalesce(x.data, struct(x.req_id, x.slug, x.apply_url, x.title, x.full_location, x.location_name, x.description, x.posted_date)))",
        schema="jobs array<struct<data:struct<req_id:string,slug:string,apply_url:string,title:string,full_location:string,location_name:string,description:string,posted_date:string>,req_id:string,slug:string,apply_url:string,title:string,full_location:string,location_name:string,description:string,posted_date:string>>", wanted="j.title <> ''",
        fields={"external_id": "coalesce(j.req_id, j.slug, '')", "url": "coalesce(j.apply_url, concat('https://', token, '.jibeapply.com/jobs/', coalesce(j.slug, '')))", "title": "j.title", "location": "coalesce(j.full_location, j.location_name)", "remote": says("j.title", "j.full_location"), "description": "j.description", "posted_at": "j.posted_date"},
    ),
    "rippling": Board(
        "rippling", "b", schema="array<struct<uuid:string,name:string,url:string,workLocation:struct<label:string>>>", wanted="j.uuid <> '' and j.name <> ''", keep="merge", html=(),
        fields={"external_id": "j.uuid", "url": "coalesce(j.url, concat('https://ats.rippling.com/', token, '/jobs/', j.uuid))", "title": "j.name", "location": "j.workLocation.label", "remote": says("j.name", "j.workLocation.label")},
    ),
    "phenom": Board(
        "phenom", "b.refineSearch.data.jobs", schema="refineSearch struct<data:struct<jobs:array<struct<reqId:string,jobId:string,applyUrl:string,title:string,city:string,multi_location:array<string>,remote:string,type:string,descriptionTeaser:string,postedDate:string>>>>", wanted="coalesce(nullif(j.reqId, ''), j.jobId, '') <> ''", html=(),
        fields={"external_id": "coalesce(j.reqId, j.jobId)", "url": "j.applyUrl", "title": "j.title", "location": few("concat(array(j.city), coalesce(j.multi_location, array()))"), "remote": f"{truthy('j.remote')} or {says('j.type')}", "description": "j.descriptionTeaser", "posted_at": "j.postedDate"},
    ),
    "gem": Board(
        "gem", "get(b, 0).data.oatsExternalJobPostings.jobPostings", schema="array<struct<data:struct<oatsExternalJobPostings:struct<jobPostings:array<struct<extId:string,title:string,locations:array<struct<name:string,city:string,isoCountry:string,isRemote:boolean>>,job:struct<locationType:string>>>>>>>", wanted="j.extId <> '' and j.title <> ''", html=(),
        fields={"external_id": "j.extId", "url": "concat('https://jobs.gem.com/', token, '/', j.extId)", "title": "j.title", "location": few("transform(j.locations, l -> coalesce(l.name, concat_ws(', ', nullif(l.city, ''), nullif(l.isoCountry, ''))))"),
                "remote": f"coalesce(exists(j.locations, l -> l.isRemote), false) or {says('j.job.locationType')}"},
    ),
    "comeet": Board(
        "comeet", "b", schema="array<struct<uid:string,name:string,location:struct<name:string,city:string,country:string,is_remote:string>,workplace_type:string,url_comeet_hosted_page:string,url_active_page:string,details:struct<description:string,requirements:string>,time_updated:string>>", wanted="j.uid <> '' and j.name <> ''",
        fields={"external_id": "j.uid", "url": "coalesce(j.url_comeet_hosted_page, j.url_active_page)", "title": "j.name", "location": f"coalesce(j.location.name, {joined('j.location.city', 'j.location.country')})", "remote": f"{truthy('j.location.is_remote')} or {says('j.workplace_type')}",
                "description": joined("j.details.description", "j.details.requirements", by="\\n"), "posted_at": "j.time_updated"},
    ),
    "getro": Board(
        "getro", "b.results.jobs", schema="results struct<jobs:array<struct<id:string,url:string,title:string,organization:struct<name:string>,locations:array<string>,work_mode:string,created_at:string>>>", wanted="j.id <> '' and j.title <> ''", html=(),
        fields={"external_id": "j.id", "url": "j.url", "title": "j.title", "company": "coalesce(j.organization.name, company)", "location": "array_join(slice(filter(j.locations, x -> x <> ''), 1, 4), '; ')", "remote": says("j.work_mode"), "posted_at": "j.created_at"},
    ),
    "avature": Board(
        "avature", blocks("item"), wanted=f"{tag('link', 'guid')} <> '' and {tag('title')} <> ''", html=("description", "title", "location"),
        fields={"external_id": rf"coalesce(nullif(regexp_extract({tag('link', 'guid')}, r'/(\d+)(?:\?|$)', 1), ''), {tag('link', 'guid')})", "url": tag("link", "guid"), "title": tag("title"), "location": f"substring_index({tag('description')}, ' - ', 1)", "remote": says(tag("title"), tag("description")), "description": tag("description")},
    ),
    "radancy": Board(
        "radancy", r"""transform(regexp_extract_all(b.results, r'(?is)<a[^>]+href="[^"]+/job/[^"]+"[^>]*>.*?</a>', 0), a -> struct(regexp_extract(a, r'(?i)href="([^"]+)"', 1) as href, regexp_extract(a, r'(?is)^<a[^>]*>(.*)</a>$', 1) as inner))""", schema="results string",
        wanted="trim(regexp_replace(j.inner, '<[^>]*>', ' ')) <> ''", keep="last", html=("description", "title"),
        fields={"external_id": r"coalesce(nullif(regexp_extract(j.href, r'/(\d+)/?$', 1), ''), case when j.href like 'http%' then j.href else concat('https://', substring_index(token, '/', 1), j.href) end)",
                "url": "case when j.href like 'http%' then j.href else concat('https://', substring_index(token, '/', 1), j.href) end", "title": "j.inner", "remote": says("j.inner"), "description": "j.inner"},
    ),
    "csod": Board(
        "csod", "b.data.requisitions", schema="data struct<requisitions:array<struct<requisitionId:string,displayJobTitle:string,locations:array<struct<city:string,state:string,country:string>>,postingEffectiveDate:string>>>", wanted="j.requisitionId <> ''", html=(),
        fields={"external_id": "j.requisitionId", "url": r"concat(regexp_replace(token, r'^([^@]+)@(\d+)$', 'https://$1.csod.com/ux/ats/careersite/$2/home/requisition/'), j.requisitionId, '?c=', substring_index(token, '@', 1))", "title": "j.displayJobTitle",
                "location": (_C := "array_join(filter(transform(j.locations, l -> concat_ws(', ', nullif(l.city, ''), nullif(l.state, ''), nullif(l.country, ''))), x -> x <> ''), '; ')"), "remote": says("j.displayJobTitle", _C), "posted_at": "j.postingEffectiveDate"},
    ),
    "jobvite": Board(
        "jobvite", blocks("job"), wanted=f"{tag('id')} <> '' and {tag('title')} <> ''", html=("description", "title", "location"),
        fields={"external_id": tag("id"), "url": tag("detail-url", "apply-url"), "title": tag("title"), "location": joined(tag("location"), tag("region")), "remote": says(tag("title"), tag("location"), tag("region")), "description": tag("description"), "posted_at": tag("date")},
    ),
    "softgarden": Board(
        "softgarden", r"""regexp_extract_all(b, r'(?is)<a[^>]+href="[^"]*/job/\d+/[^"]*"[^>]*>.*?</a>', 0)""", keep="first", wanted="trim(regexp_replace(j, '<[^>]*>', ' ')) <> ''", html=("title",),
        fields={"external_id": r"regexp_extract(j, r'/job/(\d+)/', 1)", "url": r"""concat('https://', token, '.softgarden.io/job/', regexp_extract(j, r'/job/(\d+/[^"?]*)', 1))""", "title": "j", "remote": says("regexp_replace(j, '<[^>]*>', ' ')", word=_HOME)},
    ),
}


def workday_posted(posted: Column, now: Column) -> Column:
    """The day that ``Posted 3 Days Ago`` means; null where it is open, as ``30+ Days Ago``."""
    low = F.lower(posted)
    ago = F.regexp_extract(low, r"(\d+)\s*days?", 1)
    days = F.when(F.contains(low, F.lit("today")), 0).when(F.contains(low, F.lit("yesterday")), 1).when(~F.contains(low, F.lit("+")) & (ago != ""), ago.cast("int"))
    return now - F.make_dt_interval(days=days)


def locale_page(region: Column, page: Column) -> Column:
    """Places of pages that put English ones first whatever their numbers, so that English titles win."""
    return F.struct(F.when(region.startswith("en"), 0).otherwise(1).alias("foreign"), page.alias("page"))


def fetched(pages: DataFrame, platform: str, now: Column | None = None) -> DataFrame:
    """The postings of ``platform`` among its fetched pages."""
    board = BOARDS[platform]
    if platform == "successfactors":
        pages = pages.withColumn("page", locale_page(F.col("region"), F.col("page")))
    if platform == "workday":
        at = now if now is not None else F.current_timestamp()
        return postings(pages, board, lambda posted: workday_posted(posted, at))
    return postings(pages, board)
