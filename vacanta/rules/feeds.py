"""Fixed values of the feeds: payload shapes and employment codes."""

GREENHOUSE = "jobs array<struct<id:bigint,title:string,absolute_url:string,content:string,first_published:string,updated_at:string,location:struct<name:string>,metadata:array<struct<name:string,value:string>>>>"
LEVER = (
    "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,workplaceType:string,categories:struct<location:string,commitment:string,allLocations:array<string>>,"
    "descriptionPlain:string,lists:array<struct<text:string,content:string>>,additionalPlain:string>>"
)
ASHBY = (
    "jobs array<struct<id:string,title:string,location:string,secondaryLocations:array<struct<location:string>>,workplaceType:string,employmentType:string,jobUrl:string,applyUrl:string,"
    "publishedAt:string,descriptionPlain:string,descriptionHtml:string,isListed:boolean>>"
)
SMARTRECRUITERS = (
    "content array<struct<id:string,name:string,releasedDate:string,company:struct<name:string>,location:struct<city:string,region:string,country:string,remote:boolean,hybrid:boolean,fullLocation:string>,"
    "typeOfEmployment:struct<id:string>>>"
)
SMARTRECRUITERS_DETAIL = "postingUrl string,jobAd struct<sections:map<string,struct<title:string,text:string>>>"
SMARTRECRUITERS_SECTIONS = ["jobDescription", "qualifications", "additionalInformation", "companyDescription"]
WORKABLE = (
    "name string,jobs array<struct<title:string,shortcode:string,employment_type:string,telecommuting:boolean,url:string,application_url:string,published_on:string,created_at:string,city:string,country:string,"
    "locations:array<struct<country:string,city:string,region:string>>,description:string>>"
)
RECRUITEE = "offers array<struct<title:string,description:string,requirements:string,city:string,country:string,location:string,remote:boolean,hybrid:boolean,employment_type_code:string,careers_url:string,published_at:string,company_name:string>>"
TEAMTAILOR = "channel struct<title:string,item:array<struct<title:string,description:string,pubDate:string,link:string,remoteStatus:string,`tt:locations`:struct<`tt:location`:array<struct<`tt:city`:string,`tt:country`:string>>>>>>"
PERSONIO = (
    "position array<struct<id:string,subcompany:string,office:string,additionalOffices:struct<office:array<string>>,additionalOffice:array<string>,name:string,employmentType:string,createdAt:string,"
    "jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>>>"
)
DIGITALRECRUITERS = "items array<struct<job_ad_id:bigint,title:string,contract:string,location:string,url:string,image_wide:struct<src:string>>>"
DIGITALRECRUITERS_DETAIL = "contract string,job_experience string,formatted_address string,brand_name string,description string,profile string,catch_phrase string,republished_at string"
WELCOMEKIT = (
    "name string,jobs array<struct<reference:string,name:string,description:string,profile:string,published_at:string,office:struct<city:string,country:struct<en:string>>,contract_type:struct<fr:string>,"
    "websites_urls:array<struct<website_reference:string,url:string>>>>"
)
WORKDAY = "jobPostings array<struct<title:string,externalPath:string,locationsText:string>>"
WORKDAY_DETAIL = "jobPostingInfo struct<title:string,jobDescription:string,location:string,additionalLocations:array<string>,country:struct<descriptor:string>,timeType:string,startDate:string,externalUrl:string>"
POLYMER = "items array<struct<id:bigint,title:string,city:string,country:string,kind_pretty:string,remoteness_pretty:string,published_at:string,job_post_url:string>>"
POLYMER_DETAIL = "description string,data struct<description:string>"
ADZUNA = "results array<struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,description:string,redirect_url:string,contract_type:string,created:string>>"
JOOBLE = "jobs array<struct<id:string,title:string,location:string,snippet:string,type:string,link:string,company:string,updated:string>>"

EMPLOYMENT = {
    "ashby": {"Intern": "internship", "Contract": "contractor", "Temporary": "fixed-term", "FullTime": "permanent"},
    "smartrecruiters": {"permanent": "permanent", "full-time": "permanent", "intern": "internship", "contract": "contractor", "temporary": "fixed-term"},
    "workable": {"Full-time": "permanent", "Contract": "contractor", "Internship": "internship", "Temporary": "fixed-term"},
    "personio": {"permanent": "permanent", "temporary": "fixed-term", "intern": "internship", "trainee": "alternance", "freelance": "contractor"},
    "adzuna": {"contract": "freelance", "permanent": "permanent"},
}
OPEN_APPLICATION = r"(?i)open application|candidature[s]? spontan"
NO_PREFERENCE = r"(?iu)pas de pr[ée]f[ée]rence"
EMPLOYMENT_FIELD = r"(?i)employment|contract|type"
UNKNOWN_EMPLOYER = "Entreprise non communiquée"
