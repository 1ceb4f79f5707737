"""Fixed word lists. Larger lexicons (abbreviations, units, airport codes) are parameters: see ``sources.lexicons``."""

#: Month names and abbreviations (fixed values).
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec".split()

#: Currency codes (fixed values).
CURRENCIES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYR BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK "
    "DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS "
    "KHR KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRO MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB "
    "PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLL SOS SRD STD SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH "
    "UGX USD UYU UZS VEF VND VUV WST XAF XCD XPF YER ZAR ZMW ZWL"
).split()

#: English stopwords (fixed values).
STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll "
    "m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

#: Contractions with their parts (fixed values).
CONTRACTIONS = {
    "can't": ("ca", "n't"), "Couldn't": ("could", "n't"), "don't": ("do", "n't"), "doesn't": ("does", "n't"), "didn't": ("did", "n't"),
    "hadn't": ("had", "n't"), "mayn't": ("may", "n't"), "mightn't": ("might", "n't"), "mustn't": ("must", "n't"), "needn't": ("need", "n't"),
    "oughtn't": ("ought", "n't"), "shan't": ("sha", "n't"), "shouldn't": ("should", "n't"), "won't": ("wo", "n't"), "wouldn't": ("would", "n't"),
    "ain't": ("ai", "n't"), "aren't": ("are", "n't"), "isn't": ("is", "n't"), "wasn't": ("was", "n't"), "weren't": ("were", "n't"),
    "haven't": ("have", "n't"), "hasn't": ("has", "n't"), "daren't": ("dare", "n't"), "i'm": ("i", "'m"), "i've": ("i", "'ve"), "i'd": ("i", "'d"),
    "i'll": ("i", "'ll"), "you've": ("you", "'ve"), "you'd": ("you", "'d"), "you'll": ("you", "'ll"), "they've": ("they", "'ve"),
    "they'd": ("they", "'d"), "they'll": ("they", "'ll"), "they're": ("they", "'re"), "we've": ("we", "'ve"), "we'd": ("we", "'d"),
    "we'll": ("we", "'ll"), "we're": ("we", "'re"), "she'd": ("she", "'d"), "she'll": ("she", "'ll"), "she's": ("she", "'s"), "he'd": ("he", "'d"),
    "he'll": ("he", "'ll"), "he's": ("he", "'s"), "it'd": ("it", "'d"), "it'll": ("it", "'ll"), "it's": ("it", "'s"), "what've": ("what", "'ve"),
    "what'd": ("what", "'d"), "what'll": ("what", "'ll"), "what're": ("what", "'re"), "who've": ("who", "'ve"), "who'd": ("who", "'d"),
    "who'll": ("who", "'ll"), "who're": ("who", "'re"), "when've": ("when", "'ve"), "when'd": ("when", "'d"), "when'll": ("when", "'ll"),
    "when're": ("when", "'re"), "where've": ("where", "'ve"), "where'd": ("where", "'d"), "where'll": ("where", "'ll"), "where're": ("where", "'re"),
    "why've": ("why", "'ve"), "why'd": ("why", "'d"), "why'll": ("why", "'ll"), "why're": ("why", "'re"), "how've": ("how", "'ve"),
    "how'd": ("how", "'d"), "how'll": ("how", "'ll"), "how're": ("how", "'re"), "there've": ("there", "'ve"), "there'd": ("there", "'d"),
    "there'll": ("there", "'ll"), "there're": ("there", "'re"), "that've": ("that", "'ve"), "that'd": ("that", "'d"), "that'll": ("that", "'ll"),
    "that're": ("that", "'re"), "let's": ("let", "'s"), "could've": ("could", "'ve"), "should've": ("should", "'ve"), "would've": ("would", "'ve"),
    "i'll've": ("i", "'ll", "'ve"), "you'll've": ("you", "'ll", "'ve"), "they'll've": ("they", "'ll", "'ve"), "it'll've": ("it", "'ll", "'ve"),
    "he'll've": ("he", "'ll", "'ve"), "she'll've": ("she", "'ll", "'ve"), "shouldn't've": ("should", "n't", "'ve"),
    "couldn't've": ("could", "n't", "'ve"), "wouldn't've": ("would", "n't", "'ve"), "i'd've": ("i", "'d", "'ve"), "you'd've": ("you", "'d", "'ve"),
    "he'd've": ("he", "'d", "'ve"), "she'd've": ("she", "'d", "'ve"), "they'd've": ("they", "'d", "'ve"), "there'd've": ("there", "'d", "'ve"),
    "it'd've": ("it", "'d", "'ve"),
}

#: Extensions of picture files (fixed values).
IMAGE_EXTENSIONS = "bmp gif ico ief jpe jpeg jpg heic heif avif pbm pgm png pnm ppm ras rgb svg tif tiff webp xbm xpm xwd".split()

#: Punctuation of ASCII (fixed values).
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
