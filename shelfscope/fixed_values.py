"""They have to be exactly these for results to be right.

Alias tables keep their line order, because the order breaks ties.
"""

# Columns: alias, brand slug, brand display, sub brand.
BRAND_ALIASES = """\
quilmes,quilmes,Quilmes,
1890,quilmes,Quilmes,1890
quilmes 1890,quilmes,Quilmes,1890
andes,andes,Andes,
andes origen,andes-origen,Andes Origen,
andes origen mendocina,andes-origen,Andes Origen,
stella,stella-artois,Stella Artois,
stella artois,stella-artois,Stella Artois,
corona,corona,Corona,
heineken,heineken,Heineken,
brahma,brahma,Brahma,
patagonia,patagonia,Patagonia,
schneider,schneider,Schneider,
imperial,imperial,Imperial,
budweiser,budweiser,Budweiser,
miller,miller,Miller,
warsteiner,warsteiner,Warsteiner,
grolsch,grolsch,Grolsch,
guinness,guinness,Guinness,
guiness,guinness,Guinness,
guinnes,guinness,Guinness,
estrella galicia,estrella-galicia,Estrella Galicia,
peroni,peroni,Peroni,
amstel,amstel,Amstel,
sol,sol,Sol,
michelob,michelob,Michelob,
michelob ultra,michelob,Michelob,
blue moon,blue-moon,Blue Moon,
bluemoon,blue-moon,Blue Moon,
leffe,leffe,Leffe,
hoegaarden,hoegaarden,Hoegaarden,
becks,becks,Beck's,
bieckert,bieckert,Bieckert,
isenbeck,isenbeck,Isenbeck,
palermo,palermo,Palermo,
iguana,iguana,Iguana,
otro mundo,otro-mundo,Otro Mundo,
antares,antares,Antares,
"""

# Columns: alias, variant slug.
VARIANT_ALIASES = """\
rubia,rubia
rubia lager,rubia
lager,rubia
tipo lager,rubia
blonde,rubia
chopp,rubia
cristal,rubia
rubia oro,rubia-oro
oro,rubia-oro
roja,roja
amber,roja
amber lager,roja
red,roja
irish red,roja
negra,negra
stout,negra
dark,negra
porter,negra
cream stout,negra
nitro cream stout,negra
ipa,ipa
india pale ale,ipa
apa,apa
american pale ale,apa
session ipa,session-ipa
pilsen,pilsen
pilsener,pilsen
golden,golden
golden ale,golden
honey,honey
honey ale,honey
scotch ale,scotch-ale
weisse,weisse
weissbier,weisse
belgian white,witbier
witbier,witbier
pure gold,pure-gold
noire,negra
dark lager,negra
dark,negra
blanche,witbier
lager negra,negra
"""

# Columns: raw millilitres, canonical millilitres.
VOLUME_ALIASES = """\
354,355
353,355
473,473
269,270
730,730
710,710
"""

UNKNOWN_VARIANT = "unknown"
ZERO_VARIANT = "zero"
UNKNOWN_BRAND = "desconocida"

# Matching.
FUZZY_THRESHOLD = 90
PLATFORM_PRIORITY = {"pedidosya": 0, "rappi": 1}
OTHER_PLATFORM_PRIORITY = 9

# Price matrix: "no price" stand-in and outlier guard.
NO_PRICE = 1e12
OUTLIER_SHARE = 0.45
OUTLIER_MIN_PRICES = 3

# Sources.
JUNK_LIST_PRICE_FACTOR = 6.0
PLAUSIBLE_LIST_PRICE_FACTOR = 2.2
MIN_PRICE = 300.0
MIN_PRICE_PER_100ML = 60.0
MIN_SNAPSHOT_PRODUCTS = 5
MAX_SNAPSHOT_AGE_HOURS = 6.0
MIN_PUBLISH_PLATFORMS = 2

# History and views.
HISTORY_RUNS = 60
DETAIL_RUNS = 48
DAY_TABLE_DAYS = 21
STORE_VIEW_DAYS = 14
STORE_VIEW_PRODUCTS = 12
PICKER_PRODUCTS = 120
FIRST_PAGE_ROWS = 150
NEXT_PAGE_ROWS = 200
STANDARD_SIZES_ML = [269, 270, 330, 354, 355, 410, 473, 500, 600, 710, 730, 970, 1000]
STANDARD_SIZE_SLACK_ML = 6
LOCAL_ZONE = "America/Argentina/Buenos_Aires"

# Source-failure alarm.
ALARM_WINDOW = "2 hours"
ALARM_PERIODS = 2
ALARM_THRESHOLD = 1

# Patterns on raw text.
ZERO_ALCOHOL = r"0[.,]0|\bcero\b|sin alcohol|\bzero\b|\b0\s*0\b|0\s*%"
VOLUME_IN_NAME = r"([0-9]+(?:[.,][0-9]+)?)\s*(ml|cc|cm3|l|lt|cl)\b"
VOLUME_TOKEN = r"[0-9]+(?:[.,][0-9]+)?\s*(?:ml|cc|cm3|l|lt|cl)\b"
PROMO_N_FOR_M = r"\b([0-9])\s*[x×]\s*([0-9])\b"
PROMO_SECOND_UNIT = r"\b(?:2|2d[oa]|2[ªa]|segunda)\b[^%0-9]{0,20}([0-9]{1,3})\s*%"
PROMO_CARD = r"tarjeta|banco|mi\s*crf|cuotas|visa|master|galicia|santander"
ACCESSORY = (
    r"\b(tarro|vaso|copa|chopera|choperas|heladera|conservadora|kit|combo|"
    r"regalo|sifon|sifón|dispenser|apertura|destapador|posavaso)\b"
)

# Patterns on normalised text.
CAN = r"\blata\b|\bcc\b"
BOTTLE = r"\bbotella\b|\bporron\b|\blong neck\b"
PACK_BEFORE = r"(?:^|\b)(?:pack\s*(?:de|x)?\s*)?([0-9]{1,2})\s*x\s*"
PACK_AFTER = r"\bx\s*([0-9]{1,2})\b"
PACK_RANGE = (2, 48)

# Embedded page data.
EMBEDDED_JSON = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'
BUILD_ID = r'"buildId":"([^"]+)"'

# Unit names.
MILLILITRE_UNITS = ["ml", "cc", "cm3", "cm³"]
LITRE_UNITS = ["l", "lt", "litro", "litros"]
CENTILITRE_UNITS = ["cl"]
