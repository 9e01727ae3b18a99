"""Values that results depend on, all in one place. They must stay as they are."""

#: Mail providers whose domains belong to no business.
PUBLIC_MAIL_DOMAINS = """
    gmail.com googlemail.com yahoo.com yahoo.co.uk yahoo.ae ymail.com rocketmail.com hotmail.com outlook.com live.com msn.com icloud.com
    me.com mac.com aol.com protonmail.com proton.me pm.me mail.com email.com gmx.com gmx.net zoho.com yandex.com tutanota.com tuta.io
    fastmail.com hushmail.com mailinator.com guerrillamail.com sharklasers.com rogers.com bellnet.ca bell.net sympatico.ca cogeco.ca shaw.ca
    telus.net videotron.ca sasktel.net eastlink.ca comcast.net sbcglobal.net att.net verizon.net cox.net charter.net spectrum.net
    centurylink.net frontier.com windstream.net earthlink.net optonline.net btinternet.com virginmedia.com sky.com talktalk.net ntlworld.com
    emirates.net.ae eim.ae etisalat.ae du.ae qatar.net.qa ooredoo.qa nyu.edu gamil.com
""".split()

#: Beginnings of such domains.
PUBLIC_MAIL_PREFIXES = """
    gmail. googlemail. yahoo. ymail. rocketmail. hotmail. outlook. live. msn. icloud. aol. protonmail. proton. yandex. gmx. zoho.
    tutanota. fastmail. mail.ru
""".split()

#: Directories, social media and market places: a result there is not a business's own site.
DIRECTORY_DOMAINS = """
    facebook.com instagram.com twitter.com x.com linkedin.com tiktok.com youtube.com pinterest.com threads.net yelp.com yelp.ca yelp.ae
    yellowpages.com yellowpages.ca yellowpages.ae tripadvisor.com tripadvisor.ca tripadvisor.ae bbb.org trustpilot.com glassdoor.com indeed.com
    mapquest.com foursquare.com zomato.com talabat.com deliveroo.com deliveroo.ae ubereats.com doordash.com grubhub.com justeat.com google.com
    google.ca google.ae maps.google.com apple.com bing.com crunchbase.com bloomberg.com reuters.com wikipedia.org wikidata.org openstreetmap.org
    manta.com dnb.com hoovers.com kompass.com chamberofcommerce.com bayut.com propertyfinder.ae dubizzle.com yallacompare.com connectuae.com
    yellowpages-uae.com canada411.ca canadapages.com pagesjaunes.ca booking.com airbnb.com expedia.com hotels.com agoda.com menulog.com.au
    eat.ch lieferando.de bizuum.com dubaitradersonline.com 2gis.ae 2gis.com connectuae.ae uaecontact.com dubaibizfinder.com finduslocal.com
    thedubaimall.com visitdubai.com aiwa.ae bestrestaurantdubaii.com mapy.com yango.com waze.com here.com mapcarta.com noon.com food.noon.com
    careem.com hungerstation.com toters.com skipcart.com instacart.com postmates.com hotelscombined.com hotelscombined.co.uk trivago.com
    trivago.ae trivago.ca kayak.com kayak.ae priceline.com fiji.travel blogspot.com wordpress.com medium.com tumblr.com reddit.com quora.com
    qdexx.com cylex.com cylex.ca brownbook.net hotfrog.com hotfrog.ca shopintoronto.com carsandcars.ca n49.com ourbis.ca 411.ca 411.info
    canpages.ca mysask411.com infobel.com zhihu.com baidu.com jingyan.baidu.com zhidao.baidu.com fresha.com vagaro.com booksy.com
    mindbodyonline.com schedulicity.com neardaddy.com smokepipeshops.com city-data.com investinganswers.com newmouth.com backindo.com
    britannica.com merriam-webster.com dictionary.com howstuffworks.com foodnetwork.com eatingwell.com allrecipes.com worldbank.org un.org
    who.int stackoverflow.com stackexchange.com github.com amazon.com amazon.ca amazon.ae ebay.com ebay.ca walmart.com walmart.ca alibaba.com
    etsy.com
""".split()

#: Words too common to tie a domain to one business.
GENERIC_BUSINESS_TERMS = """
    fashion beauty salon cafe restaurant food market store shop mart auto dental medical health service services trading general kitchen
    grill pizza coffee hotel travel tour tours fitness clinic pharmacy mobile computer digital tech media print photo electric
    electronics sign care personal super plus express premium classic modern barber nails spa studio lab consulting realty properties
    rentals cleaning repair repairs parts supplies wholesale retail packaging logistics shipping delivery transport construction building
    plumbing roofing flooring catering bakery grocery laundry tailor jewellery jewelry optical dentist doctor lawyer candle light night
    star gold silver royal grand golden smart fresh clean bright paradise diamond crystal pearl ruby jade emerald island park garden
    urban village city center centre global international world pacific atlantic northern southern eastern western belgium germany france
    italy turkey jordan lebanon morocco america canada brazil mexico thailand vietnam malaysia indonesia africa europe kingdom dynasty
    empire chapter element essence fusion cascade pioneer horizon phoenix genesis vintage premier prestige supreme triumph liberty fortune
    destiny miracle best first great good quality standard
""".split()

#: Articles and prepositions.
ARTICLES = """
    the a an and & of in at to for by on al el le la les de du des et
""".split()

#: Legal forms.
ENTITY_SUFFIXES = """
    llc ltd inc corp co company plc fzc fze fz est wll spc dmcc pllc lp llp
""".split()

#: Trade words that names carry and domains drop.
TRADE_WORDS = """
    services service solutions solution group enterprise enterprises trading general international global center centre shop store mart
    market plaza mall ladies gents mens womens children kids textiles textile tailoring tailor upholstery materials supplies supply
    equipment parts maintenance repair repairs installation installations cleaning laundry salon spa beauty barber restaurant cafe
    cafeteria bakery grill kitchen pharmacy medical dental clinic hospital electrical electric electronics electronic lighting lights light
    plumbing heating cooling furniture furnishing furnishings flooring printing print graphics graphic design photography photo photos
    video media fitness gym wellness yoga travel tours tourism transport transportation logistics shipping cargo freight school academy
    institute university college consultants consulting consultant advisory management properties property real estate contracting
    construction building builders
""".split()

#: Words for places and grades.
LOCATION_WORDS = """
    street avenue road drive boulevard lane place way court circle terrace crescent square north south east west central upper lower
    college park lake hill mountain river bay city town village downtown midtown uptown first second third main high grand new old
    big little great royal golden green blue red white black national international global general universal auto car home food tech
    pro express quick fast best top prime elite premium
""".split()

#: Marks of parked, for-sale and default pages.
PAGE_PARKED_MARKS = [
    'domain is for sale',
    'buy this domain',
    'parked free',
    'parked by',
    'this domain may be for sale',
    'godaddy.com/domain',
    'sedoparking',
    'hugedomains',
    'dan.com',
    'afternic',
    'namecheap.com/domains',
    'domain parking',
    'this webpage was generated by the domain owner',
    'is for sale',
    'is available for purchase',
    'bodis.com',
    'for sale</title>',
    'for sale |',
    'for sale -',
    'href="/lander"',
    'window.location.href="/lander"',
    'domain has been registered',
    'this domain is registered',
    'sav.com',
    'porkbun.com',
    'coming soon</title>',
    'coming soon |',
    'under construction</title>',
    'site coming soon',
    'website coming soon',
    'launching soon',
    'hover realnames',
    'realnames',
    'a more meaningful email',
    'namecheap.com',
    'squarespace.com/domain',
    'premium domain',
    'high value domain',
    'domain names for sale',
    'domain name for sale',
    'domain marketplace',
    'domain auction',
    'domain portfolio',
    'category-defining',
    'category defining',
    'brandable domain',
    'exact match domain',
    'domain registered at',
    'domain default page',
    'default web site page',
    'this site is under construction',
    'this account has been suspended',
    'web hosting by',
    'cpanel',
    'plesk default page',
    'welcome to nginx',
    'apache2 default page',
    'it works!',
    'test page for the apache',
    'congratulations! your new host',
]

#: Marks of a parked domain in its page.
PARKED_KEYWORDS = [
    'domain for sale',
    'buy this domain',
    'this domain is for sale',
    'domain parked',
    'parkingcrew',
    'sedo',
    'afternic',
    'bodis',
    'namecheap',
    'dan.com',
    'cashparking',
    'click here to inquire',
]

#: Marks of a parked domain in host names.
PARKED_HOSTS = """
    parkingcrew sedoparking bodis afternic dan.com namecheap hugedomains
""".split()

#: Endings that make a name look like a domain.
NAME_TLDS = ".com .ca .ae .qa .io .co .net .org .biz .info .us .uk .app .dev .shop .store".split()

#: Mail domains that search results may show.
RESULT_MAIL_DOMAINS = "gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com mail.com protonmail.com".split()

#: Words that say nothing about a name.
NAME_STOP_WORDS = "the a an and of in at to for by le la les de du al".split()
PLACE_STOP_WORDS = "the a an and & of in at to for - le la les de du".split()
PAGE_STOP_WORDS = "the and for from with that this our your all new one two".split()

#: Top-level domains to try for each country, in order.
COUNTRY_TLDS = {
    "AE": [".ae", ".com", ".net"],
    "CA": [".ca", ".com", ".net"],
    "QA": [".qa", ".com", ".net"],
    "US": [".com", ".us", ".net", ".org"],
    "GB": [".co.uk", ".com", ".net", ".org"],
    "UK": [".co.uk", ".com", ".net", ".org"],
    "AU": [".com.au", ".com", ".net"],
    "IN": [".in", ".com", ".net"],
    "SA": [".sa", ".com", ".net"],
    "KW": [".kw", ".com", ".net"],
    "BH": [".bh", ".com", ".net"],
    "OM": [".om", ".com", ".net"],
    "JO": [".jo", ".com", ".net"],
    "LB": [".lb", ".com", ".net"],
    "EG": [".eg", ".com", ".net"],
    "PK": [".pk", ".com", ".net"],
}
OTHER_TLDS = [".com", ".net"]

#: Weight of each result of each evidence source, and of a result that is not listed.
EVIDENCE_WEIGHTS = {
    "domain_guess": {"no_match": "0.70", "has_website": "1.00", "no_candidates": "0.10"},
    "searxng": {"no_website": "0.90", "has_website": "1.00", "no_results": "0.10"},
    "llm": {"no_website": "0.80", "has_website": "0.90", "not_sure": "0.20", "no_results": "0.10"},
    "ddg": {"no_website": "0.60", "has_website": "0.80", "no_results": "0.05"},
    "google_search": {"no_website": "0.60", "has_website": "0.80", "no_results": "0.05", "blocked": "0.00"},
    "google_places": {"no_website": "0.90", "has_website": "1.00"},
    "foursquare": {"no_website": "0.70", "has_website": "0.90"},
}
UNLISTED_WEIGHT = "0.10"
CONFIDENCE_LEVELS = ["high", "medium", "low", "unverified"]
CONCLUSIVE_RESULTS = ["no_website", "no_match", "has_website"]

#: Domain statuses by what they mean for a lead.
VERIFIED_UNHOSTED = ["verified_unhosted", "checked", "no_mx", "enriched", "no_contacts"]
UNREGISTERED = ["unregistered_candidate"]
REGISTERED = ["registered_no_web", "registered_dns_only", "mx_missing"]
UNKNOWN_STATUS = ["new", "rdap_error", "dns_error", "skipped", ""]

#: Categories by priority.
HIGH_CATEGORIES = ["trades", "contractors"]
MEDIUM_CATEGORIES = ["professional_services", "retail", "health", "food", "auto"]

ROLE_PREFIXES = ["info", "admin", "sales", "support", "contact"]

#: Places of interest: marks of writing direction, texts that are no value, values of ``amenity`` by class (fixed values).
BIDI_MARKS = "⁦⁧⁨⁩‎‏"
NOT_A_VALUE = ["", "-", "n/a", "na", "none", "null", "unknown", "0"]

AMENITIES = {
    "food": ["restaurant", "cafe", "fast_food", "food_court", "bar", "pub"],
    "health": ["clinic", "hospital", "doctors", "dentist", "pharmacy"],
    "education": ["school", "college", "university", "kindergarten"],
    "finance": ["bank", "bureau_de_change", "atm"],
    "religious": ["place_of_worship"],
    "auto": ["fuel", "car_wash", "car_rental", "car_repair"],
}
