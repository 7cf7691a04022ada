"""Schemas of stored tables."""

from __future__ import annotations

LINK = "struct<text:string,href:string,attributes:map<string,string>,rel:string,link_title:string,isInternal:boolean>"
#: A page record as crawlers write it, one JSON object on a line; absent sections are null.
PAGE = f"""url string, title string, fullText string, timestamp string, etag string, response_id string, content_id string,
response struct<status:int,statusText:string,headers:map<string,string>,url:string>,
seo struct<metaTags:map<string,string>,specialLinks:struct<canonical:string,
alternate:array<struct<href:string,hreflang:string,media:string,type:string>>>,hasDataNoSnippet:boolean>,
aiMetadata struct<structuredData:struct<jsonLd:array<variant>>,customMetadata:struct<wordCount:int,readingTime:string,
headingStructure:array<struct<level:int,text:string>>,language:string>>,
links struct<internal:array<{LINK}>,external:array<{LINK}>,total:int>,
htmlContent struct<full:string,main:string,mainSelector:string>,
images array<struct<src:string,alt:string,title:string,width:string,height:string,srcset:string,loading:string>>"""
URL_INDEX = "url string, id string, status string, domain string, retryCount int, timestamp string, error string"
REQUEST_LOG = "timestamp long, url string, success boolean, statusCode int"
CRAWL_METADATA = """domain string, crawlDate string, timestamp string, totalUrls long,
sitemapUrls array<struct<url:string,lastmod:string,changefreq:string,priority:string>>,
urlIndex map<string,struct<status:string,timestamp:string,lastModified:string>>"""
