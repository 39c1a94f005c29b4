"""Payload families and provider specs on landed fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from rolecast.sources import boards, landing, normalize, providers, search

NOW = "2026-09-25 12:00:00"


def land(spark, *payloads):
    rows = [(p.get("source"), p.get("entry", ""), p.get("url", "https://feed.example.com/1"), p.get("status", 200), p["body"]) for p in payloads]
    df = spark.createDataFrame(rows, "source string, entry string, url string, http_status int, body string")
    return df.withColumn("fetched_at", F.lit(NOW).cast("timestamp")).select("source", "entry", "fetched_at", "url", "http_status", "body")


def jobs(spark, *payloads, now=NOW):
    raw = land(spark, *payloads)
    got = normalize.provider_jobs(raw, now, tuple({p["source"] for p in payloads}))
    return [r.asDict(recursive=True) for r in got.orderBy("page", "pos").collect()]


def pick(rows, *fields):
    return [tuple(r[f] for f in fields) for r in rows]


JSON_CASES = {
    "remotli": ({"jobs": [{"jobs": {"title": "UX", "status": "active", "slug": "ux-1", "location": "Remote", "allLocations": ["remote", "Chile"],
                                    "salaryMin": 9, "salaryMax": 5, "salaryCurrency": "usd"}, "companies": {"name": "Acme"}},
                          {"jobs": {"title": "Old", "slug": "o"}}]}, [("UX", "https://remotli.ch/jobs/ux-1", "Acme", "Remote; Chile")]),
    "jobicy": ({"jobs": [{"jobTitle": "UX", "url": "https://jobicy.com/j/1", "companyName": "Acme", "jobGeo": "LATAM"}, {"jobTitle": "X", "url": "https://evil.com/1"}]},
               [("UX", "https://jobicy.com/j/1", "Acme", "LATAM")]),
    "torre": ({"results": [{"id": "abcd1", "objective": "UX", "organizations": [{"name": " "}, {"name": "Acme"}], "locations": ["Chile"], "remote": True},
                           {"id": "abcd2", "objective": "Shut", "status": "closed"}]}, [("UX", "https://torre.ai/post/abcd1", "Acme", "Remote — Chile")]),
    "remoteok": ([{"legal": "x"}, {"position": "UX", "url": "https://remoteok.com/1", "company": "Acme", "location": "Worldwide"}],
                 [("UX", "https://remoteok.com/1", "Acme", "Worldwide")]),
    "workingnomads": ([{"title": "UX", "url": "https://w.com/1", "company_name": "Acme", "location": "Anywhere"}], [("UX", "https://w.com/1", "Acme", "Anywhere")]),
    "himalayas": ({"jobs": [{"title": "UX", "applicationLink": "https://evil.com", "guid": "https://himalayas.app/j/1", "companyName": "Acme",
                             "locationRestrictions": ["Brazil", "Chile"], "pubDate": 1790000000}]}, [("UX", "https://himalayas.app/j/1", "Acme", "Brazil, Chile")]),
    "getonbrd": ({"data": [{"attributes": {"title": "UX", "countries": ["Chile"], "published_at": 1790000000, "company": {"data": {"attributes": {"name": "Acme"}}}},
                            "links": {"public_url": "https://www.getonbrd.com/j/1"}}]}, [("UX", "https://www.getonbrd.com/j/1", "Acme", "Chile")]),
    "landingjobs": ([{"title": "UX", "url": "https://landing.jobs/at/acme-co/ux", "locations": [{"city": "Lisboa", "country_code": "PT"}], "remote": True}],
                    [("UX", "https://landing.jobs/at/acme-co/ux", "Acme Co", "Lisboa, PT, Remote")]),
    "wttj": ({"hits": [{"name": "UX", "slug": "ux", "organization": {"slug": "acme", "name": "Acme"}, "offices": [{"city": "Paris", "country": "France"}],
                        "remote": "fulltime", "salary_yearly_minimum": 50000, "salary_maximum": 900, "salary_period": "monthly", "salary_currency": "eur"}]},
             [("UX", "https://www.welcometothejungle.com/en/companies/acme/jobs/ux", "Acme", "Paris, France, Remote")]),
    "a16z-speedrun-talent": ({"jobs": [{"title": "UX", "url": "https://speedrun-talent-network.com/1", "location": "NY", "remote": True}]},
                             [("UX", "https://speedrun-talent-network.com/1", "a16z speedrun talent network", "NY, Remote")]),
    "4dayweek": ({"jobs": [{"title": "UX", "slug": "ux-1", "company": {"name": "Acme"}, "locations": [{"city": "Rome", "country": "IT"}], "work_arrangement": "remote"},
                           {"title": "Old", "slug": "old", "is_expired": True}]}, [("UX", "https://4dayweek.io/job/ux-1", "Acme", "Rome, IT, Remote")]),
    "themuse": ({"results": [{"name": "UX", "refs": {"landing_page": "https://www.themuse.com/j/1"}, "company": {"name": "Acme"}, "locations": [{"name": "A"}, {"name": "B"}]}]},
                [("UX", "https://www.themuse.com/j/1", "Acme", "A")]),
    "ashby": ({"jobs": [{"title": "UX", "jobUrl": "https://jobs.ashbyhq.com/a/1", "location": "NY", "secondaryLocations": [{"location": "SP", "address": {"postalAddress": {"addressCountry": "Brazil"}}}],
                         "isRemote": True, "compensation": {"minValue": 40, "maxValue": 30, "interval": "1 HOUR", "currency": "usd"}}]},
              [("UX", "https://jobs.ashbyhq.com/a/1", "Acme", "NY · SP · Brazil · Remote")]),
    "lever": ([{"text": "UX", "hostedUrl": "https://jobs.lever.co/a/1", "categories": {"location": "NY", "allLocations": ["ny", "SP"]}, "createdAt": 1790000000000}],
              [("UX", "https://jobs.lever.co/a/1", "Acme", "NY; SP")]),
    "bamboohr": ({"result": [{"id": 7, "jobOpeningName": "UX", "location": {"city": "SP", "state": "SP"}, "isRemote": True}]},
                 [("UX", "https://feed.example.com/careers/7", "Acme", "SP, SP, Remote")]),
    "breezy": ([{"name": "UX", "url": "https://a.breezy.hr/p/1", "location": {"city": "SP", "country": {"name": "Brazil"}, "is_remote": True}}],
               [("UX", "https://a.breezy.hr/p/1", "Acme", "SP, Brazil, Remote")]),
    "comeet": ([{"name": "UX", "url_comeet_hosted_page": "https://www.comeet.com/1", "location": {"name": "Remote IL", "is_remote": True}}],
               [("UX", "https://www.comeet.com/1", "Acme", "Remote IL")]),
    "gem": ({"job_posts": [{"title": "UX", "absolute_url": "https://jobs.gem.com/acme/1", "location": {"name": "NY", "isRemote": True}}, {"title": "X", "absolute_url": "https://x.com"}]},
            [("UX", "https://jobs.gem.com/acme/1", "Acme", "NY · Remote")]),
    "pinpoint": ({"data": [{"title": "UX", "url": "https://a.pinpointhq.com/1", "location": {"city": "SP", "province": "SP"}}]}, [("UX", "https://a.pinpointhq.com/1", "Acme", "SP, SP")]),
    "recruitee": ({"offers": [{"title": "UX", "careers_url": "https://a.recruitee.com/o/ux", "city": "SP", "country": "Brazil", "remote": True}]},
                  [("UX", "https://a.recruitee.com/o/ux", "Acme", "SP, Brazil, Remote")]),
    "rippling": ([{"name": "UX", "url": "https://ats.rippling.com/a/1", "workLocation": {"label": "SP"}}, {"name": "UI", "url": "https://ats.rippling.com/a/2", "workLocation": "RJ"}],
                 [("UX", "https://ats.rippling.com/a/1", "Acme", "SP"), ("UI", "https://ats.rippling.com/a/2", "Acme", "RJ")]),
}
FEED_CASES = {
    "cryptocurrencyjobs": ("<rss><item><title>Designer at Large at Acme</title><link>https://c.com/1</link></item></rss>", [("Designer at Large", "https://c.com/1", "Acme", "Remote")]),
    "nodesk": ("<rss><item><title>UX at Acme</title><link>https://nodesk.co/1</link></item><item><title>X</title><link>https://evil.com</link></item></rss>",
               [("UX", "https://nodesk.co/1", "Acme", "")]),
    "jobspresso": ("<rss><item><title>UX</title><link>https://jobspresso.co/1</link><job_listing:company>Acme</job_listing:company><job_listing:location>LATAM</job_listing:location></item></rss>",
                   [("UX", "https://jobspresso.co/1", "Acme", "LATAM")]),
    "teamtailor": ("<rss><item><title>UX</title><link>https://a.teamtailor.com/1</link><tt:city>SP</tt:city><tt:country>Brazil</tt:country></item><item><title>UI</title>"
                   "<link>https://a.teamtailor.com/2</link><remoteStatus>fully</remoteStatus></item></rss>",
                   [("UX", "https://a.teamtailor.com/1", "Acme", "SP, Brazil"), ("UI", "https://a.teamtailor.com/2", "Acme", "Remote")]),
    "jobvite": ("<result><job><title>UX &amp; UI</title><apply-url>http://a.com/1</apply-url><location>SP</location></job></result>", [("UX & UI", "https://a.com/1", "Acme", "SP")]),
    "personio": ("<w><position><id>12</id><jobDescriptions><name>noise</name></jobDescriptions><name>UX</name><office>SP</office><office>RJ</office><office>SP</office></position></w>",
                 [("UX", "https://feed.example.com/job/12", "Acme", "SP, RJ")]),
    "join": ('<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"initialState":{"company":{"domain":"acme"},"jobs":{"items":[{"title":"UX","idParam":"1-ux","city":{"cityName":"Berlin"}}]}}}}}</script>',
             [("UX", "https://join.com/companies/acme/jobs/1-ux", "Acme", "Berlin")]),
}


@pytest.mark.parametrize("source", [*JSON_CASES, *FEED_CASES])
def test_provider_mapping(spark, source):
    body, want = (lambda c: (json.dumps(c[0]) if source in JSON_CASES else c[0], c[1]))(({**JSON_CASES, **FEED_CASES})[source])
    entry = "" if source == "a16z-speedrun-talent" else "Acme"
    got = jobs(spark, dict(source=source, entry=entry, body=body), dict(source=source, entry=entry, body="{broken", url="https://feed.example.com/2"))
    assert pick(got, "title", "url", "company", "location") == want


def test_pay_of_providers(spark):
    got = {r["source"]: r["salary"] for r in jobs(spark, *[dict(source=s, entry="Acme", body=json.dumps(JSON_CASES[s][0])) for s in ("ashby", "remotli", "wttj")])}
    assert got["ashby"] == {"min": 62400.0, "max": 83200.0, "currency": "USD"}
    assert got["remotli"] == {"min": 5.0, "max": 9.0, "currency": "USD"}
    assert got["wttj"] == {"min": 50000.0, "max": 50000.0, "currency": "EUR"}


def test_cards_join_list_rows_by_id(spark):
    item = lambda i: json.dumps({"@type": "ListItem", "position": i, "name": f"UX {i}", "url": f"https://builtin.com/job/ux/{i}"}, separators=(",", ":"))
    card = ('<a x href="/company/acme">Ac&amp;me</a><a data-id="job-card-title" data-builtin-track-job-id="1">UX</a><i class="fa-house-building"></i><div><span>Remote</span></div>'
            '<i class="fa-location-dot"></i><span>2 Locations</span><span aria-label="Job locations" data-bs-title="&lt;div&gt;NY&lt;/div&gt;&lt;div&gt;SP&lt;/div&gt;"></span>'
            '<i class="fa-clock"></i><span>3 Days Ago</span><i class="fa-sack-dollar"></i><span>100K-120K Annually</span>')
    got = jobs(spark, dict(source="builtin", body=f'{{"list":[{item(1)},{item(2)}]}}{card}'))
    assert pick(got, "title", "company", "location") == [("UX 1", "Ac&me", "Remote · NY · SP"), ("UX 2", None, "")]
    assert got[0]["salary"]["max"] == 120000.0 and got[0]["posted_at"].day == 22


def test_generalist_cards_and_layout_drift(spark):
    card = lambda co: f'<a class="gw-job-card" href="/jobs/ux-1" data-region="latam"><div class="gw-job-title">UX</div><div class="gw-job-company">{co}</div></a>'
    page = f'<!-- {card("Ghost")} --><div class="gw-jobs-section">{card("Acme")}</div>'
    assert pick(jobs(spark, dict(source="generalist-world", body=page)), "title", "url", "company", "location") == [
        ("UX", "https://generalist.world/jobs/ux-1/", "Acme", "LATAM")]
    raw = land(spark, dict(source="generalist-world", url="a", body=page), dict(source="generalist-world", url="b", body=card("")),
               dict(source="generalist-world", url="c", body="<p>new site</p>"))
    assert {r.url: r.layout_suspeito for r in providers.layout_drift(raw).collect()} == {"a": False, "b": True, "c": True}


def test_deleted_and_dead_comments_are_no_jobs_and_the_rest_have_dates(spark):
    text = "Acme | UX | Remote | https://a.com/1"
    body = {"children": [{"text": text, "created_at": "2026-09-01T10:00:00.000Z"}, {"text": text + "2", "deleted": True}, {"text": text + "3", "dead": True}]}
    got = jobs(spark, dict(source="hackernews", body=json.dumps(body)))
    assert [(r["url"], r["posted_at"].date().isoformat()) for r in got] == [("https://a.com/1", "2026-09-01")]


def test_details_of_the_newest_landing_are_joined_once(spark):
    site = "https://acme.wd1.myworkdayjobs.com"
    listed = {"jobPostings": [{"title": "UX", "externalPath": "/job/X/UX_R1", "locationsText": "3 Locations", "postedOn": "Posted Today"}]}
    detail = lambda *places: json.dumps({"jobPostingInfo": {"location": places[0], "additionalLocations": list(places[1:])}})
    raw = land(spark, dict(source="workday", entry="Acme", url=f"{site}/wday/cxs/acme/jobs", body=json.dumps(listed)),
               dict(source="workday", entry="Acme", url=f"{site}/job/X/UX_R1", body=detail("Old")))
    again = land(spark, dict(source="workday", entry="Acme", url=f"{site}/job/X/UX_R1", body=detail("Lima", "Remote"))).withColumn(
        "fetched_at", F.lit("2026-09-26 00:00:00").cast("timestamp"))
    got = normalize.provider_jobs(raw.unionByName(again), NOW, ("workday",)).collect()
    assert [(r.title, r.location) for r in got] == [("UX", "Lima · Remote")]


def test_the_landing_zone_is_cut_by_source_and_day(spark, tmp_path):
    landing.write_raw(land(spark, dict(source="a", body="x"), dict(source="b", body="y")), f"{tmp_path}/raw")
    raw = landing.read_raw(spark, f"{tmp_path}/raw")
    assert landing.payloads(raw, "a", since="2026-09-25 00:00:00").count() == 1
    assert landing.payloads(raw, "a", since="2026-09-26 00:00:00").count() == 0


def test_free_text_header_and_latest_thread(spark):
    got = jobs(spark, dict(source="hackernews", body=json.dumps({"children": [{"text": 'Acme | UX Designer | Remote (LATAM) | <a href="https://acme.com/j">x</a><p>more'}, {"text": "no link here"}]})))
    assert pick(got, "company", "location", "url")[0] == ("Acme", "Remote (LATAM)", "https://acme.com/j")
    hits = {"hits": [{"title": "Ask HN: Freelancer?", "objectID": "1"}, {"title": "Ask HN: Who is hiring? (Sep)", "objectID": "2"}, {"title": "Ask HN: Who is hiring? (Aug)", "objectID": "3"}]}
    assert providers.latest_thread(land(spark, dict(source="hackernews", body=json.dumps(hits)))).first().thread_id == "2"


def test_workday_keys_details_and_offices(spark):
    page = {"jobPostings": [{"title": "UX", "externalPath": "/job/SP/UX_R123", "locationsText": "2 Locations", "postedOn": "Posted 30+ Days Ago"},
                            {"title": "UX", "externalPath": "/job/SP/UX_R123-2", "postedOn": "Posted Today"}]}
    base = "https://acme.wd1.myworkdayjobs.com"
    raw = land(spark, dict(source="workday", entry="Acme", url=base + "/wday", body=json.dumps(page)))
    got = normalize.provider_jobs(raw, NOW, ("workday",))
    assert got.count() == 1 and got.first().posted_at is None
    detail = land(spark, dict(source="workday-detail", url=base + "/job/SP/UX_R123", body=json.dumps(
        {"jobPostingInfo": {"location": "SP", "additionalLocations": ["RJ", "SP"], "startDate": "2026-09-01"}})))
    r = providers.workday_details(got, detail).first()
    assert r.location == "SP · RJ" and r.posted_at.day == 1
    offices = {"offices": [{"name": "LATAM", "departments": [], "children": [{"name": "SP", "departments": [{"jobs": [{"id": 7}]}], "children": []}]}]}
    names = providers.office_map(land(spark, dict(source="greenhouse", entry="Acme", body=json.dumps(offices))))
    gh = normalize.provider_jobs(land(spark, dict(source="greenhouse", entry="Acme", body=json.dumps({"jobs": [
        {"id": 7, "title": "UX", "absolute_url": "https://boards.greenhouse.io/a/jobs/7", "location": {"name": "Hybrid"}}]}))), NOW, ("greenhouse",))
    assert providers.with_offices(gh, names).first().location == "Hybrid · SP"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_national_boards(spark):
    gupy = {"data": [{"id": 1, "name": "Product Designer", "description": "&lt;p&gt;Ol&aacute;&lt;/p&gt;", "workplaceType": "presential"}, {"id": 1, "name": "again"}]}
    r = one(boards.gupy(land(spark, dict(source="gupy", body=json.dumps(gupy))), NOW))
    assert (r.id_externo, r.descricao, r.modelo, r.remoto, r.pais) == ("gupy:1", "Olá", "presencial", False, "Brasil")
    remotar = {"data": [{"id": 2, "title": "UX", "type": "remote", "description": "a", "jobRequirements": [{"description": "b"}, "c"], "active": False,
                         "jobSalary": {"from": 9000, "to": None, "currency": "BRL", "type": "monthly"}}]}
    r = one(boards.remotar(land(spark, dict(source="remotar", body=json.dumps(remotar))), NOW))
    assert (r.descricao, r.encerrada, r.salario_bruto.de, r.salario_bruto.periodo) == ("a b c", True, 9000.0, "mes")
    ct = [{"id": 3, "title": {"rendered": "Vaga home office: Product Designer na Asaas &#8211; SP"}, "content": {"rendered": "x"}, "date": "2026-09-01T10:00:00"},
          {"id": 4, "title": {"rendered": "Contador na X"}}]
    r = one(boards.coluna_tech(land(spark, dict(source="colunatech", body=json.dumps(ct))), NOW))
    assert (r.titulo, r.empresa, r.publicada_em.day) == ("Product Designer", "Asaas", 1)


def test_detail_pages_enrich_list_rows(spark):
    pages = [dict(source="inhire", entry="mjv", url="https://api/pages", body=json.dumps({"jobsPage": [{"jobId": "u1", "displayName": "Product Designer | UX"}, {"jobId": "u2", "displayName": "Contador"}]})),
             dict(source="inhire", entry="mjv", url="https://api/pages/u1", body=json.dumps({"status": "closed", "description": "<b>x</b>", "workplaceType": "Remote", "tenantName": "MJV"}))]
    r = one(boards.inhire(land(spark, *pages), NOW))
    assert (r.link, r.encerrada, r.descricao, r.modelo, r.empresa) == ("https://mjv.inhire.app/vagas/u1/product-designer-or-ux", True, "x", "remoto", "MJV")
    feed = "<rss><item><title>UX</title><link>https://vagasremotas.com.br/ux</link><description>short</description><pubDate>Thu, 24 Sep 2026 10:00:00 +0000</pubDate></item></rss>"
    page = "<p>menu Apply for job " + "texto " * 80 + "Vaga em Dólar</p>"
    r = one(boards.vagas_remotas(land(spark, dict(source="vagasremotas", url="https://vagasremotas.com.br/?feed=job_feed", body=feed),
                                      dict(source="vagasremotas", url="https://vagasremotas.com.br/ux", body=page)), NOW))
    assert r.descricao.startswith("texto") and r.paga_em_dolar is True
    item = ('<div class="notion-collection-list__item x"><a href="/oportunidades/v1"></a><div class="notion-property__title">Acme</div><span class="notion-pill">PJ</span>'
            '<span class="notion-pill">Product Designer</span><div class="notion-property__date">Mar 5, 2026 6:28 PM</div>')
    r = one(boards.vagas_ux(land(spark, dict(source="vagasux", url="https://vagasux.com.br/oportunidades/vagas-remotas", body="<x>" + item),
                                 dict(source="vagasux", url="https://vagasux.com.br/oportunidades/v1", body="<p>menu Descrição da vaga: " + "y" * 60 + "</p>")), NOW))
    assert (r.titulo, r.empresa, r.contrato, r.remoto, r.descricao_pendente) == ("Product Designer", "Acme", "PJ", True, False)
    assert r.descricao.startswith("Descrição") and r.publicada_em.hour == 18


def test_international_boards(spark):
    lst = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"arcJobs":[{"randomKey":"k","title":"UX","urlString":"ux","requiredCountries":[],"minAnnualSalary":1000,"minHourlyRate":9},' \
          '{"randomKey":"z","title":"UX","urlString":"us","requiredCountries":["US"]}]}}}</script>'
    det = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"job":{"description":"**Do** it","postedAt":1790000000},"company":{"name":"Acme"}}}}</script>'
    r = one(boards.arc(land(spark, dict(source="arc", url="https://arc.dev/remote-jobs/ux-design", body=lst), dict(source="arc", url="https://arc.dev/remote-jobs/details/ux-k", body=det)), NOW))
    assert (r.id_externo, r.empresa, r.descricao, r.salario_bruto.periodo) == ("arc:k", "Acme", "Do it", "ano")
    idx = [{"s": "a-1", "u": "https://x.com/1", "t": "Product Designer - Acme", "co": "Acme", "l": "LATAM", "wp": "Remote", "p": 1790000000000},
           {"s": "b-1", "u": "https://x.com/2", "t": "Product Designer", "l": "Anywhere", "wp": "Hybrid"}, {"s": "c-1", "u": "https://x.com/3", "t": "Product Designer", "l": "Europe", "rm": 1},
           {"s": "d-1", "u": "https://x.com/4", "t": "Product Designer", "l": "LATAM", "rm": 1, "sl": "DOU (Ukraine)"}]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","description":"' + "long text " * 8 + '"}]}</script>'
    r = one(boards.ux_jobs(land(spark, dict(source="uxjobs", url="https://jobs.uxjobs.io/", body=f'<script id="jobs-data">{json.dumps(idx)}</script>'),
                                dict(source="uxjobs", url="https://jobs.uxjobs.io/jobs/a-1/", body=ld)), NOW))
    assert (r.titulo, r.remoto, r.descricao_pendente) == ("Product Designer", True, False)
    lever = [{"id": "1", "text": "Product Designer", "hostedUrl": "https://jobs.lever.co/a/1", "workplaceType": "remote", "categories": {"location": "Brazil"}, "lists": [{"text": "Do", "content": "<li>x</li>"}]},
             {"id": "2", "text": "Product Designer", "hostedUrl": "https://jobs.lever.co/a/2", "categories": {"location": "New York"}}]
    r = one(boards.ats(land(spark, dict(source="ats-lever", entry="Acme", body=json.dumps(lever))), "lever", NOW))
    assert (r.id_externo, r.descricao, r.modelo, r.elegibilidade_latam) == ("lever:1", "Do x", "remoto", True)
    page = ('<script type="application/ld+json">{"@type":"JobPosting","url":"https://wellfound.com/jobs/1-ux","title":"UX Lead","description":"d","jobLocationType":"TELECOMMUTE","datePosted":"2026-02-30"}</script>'
            '<a href="/jobs/1-ux?x=1">UX again</a><a href="/jobs/2-ui">UI role</a><a href="https://evil.com/jobs/3-x">No way</a>')
    got = {r.link: (r.titulo, r.remoto, r.publicada_em, r.descricao_pendente) for r in boards.portal(land(spark, dict(source="wellfound", body=page)), "wellfound", NOW).collect()}
    assert got == {"https://wellfound.com/jobs/1-ux": ("UX Lead", True, None, False), "https://wellfound.com/jobs/2-ui": ("UI role", None, None, True)}


def test_a_broken_source_is_a_line_of_the_report(spark, tmp_path):
    raw = land(spark, dict(source="remotive", body="{broken"), dict(source="remotive", body=None), dict(source="jobicy", status=500, body="x"),
               dict(source="remoteok", body=json.dumps([{"position": "Product Designer", "url": "https://remoteok.com/1", "location": "Worldwide"}])))
    report = normalize.land_postings(raw, NOW, f"{tmp_path}/postings", ("remotive", "remoteok"))
    assert [r["erro"] for r in report] == [None, None]
    assert spark.read.parquet(f"{tmp_path}/postings").count() == 1
    assert {r.source: r.falhas for r in normalize.counters(raw).collect()} == {"remotive": 2, "jobicy": 1, "remoteok": 0}
    landing.write_raw(raw, f"{tmp_path}/raw")
    assert landing.read_raw(spark, f"{tmp_path}/raw").filter("source = 'remotive'").count() == 2


def test_search_links_and_url_lists(spark, tmp_path):
    page = 'x uddg=https%3A%2F%2Fa.com%2F1&z" href="https://b.com/2" href="https://duckduckgo.com/x" href="https://c.com/a.js" href="https://b.com/2"'
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(search.search_result_links(F.col("h")).alias("l")).first().l == ["https://a.com/1", "https://b.com/2"]
    (tmp_path / "urls.txt").write_text("# note\n\n https://a.com \nhttps://b.com\n")
    assert [r.url for r in search.url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a.com", "https://b.com"]
