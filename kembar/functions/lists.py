"""Word lists and phrases that results depend on."""

# Indonesian stop words, fixed values.
STOP_WORDS = (
    "saya", "aku", "kamu", "anda", "dia", "ia", "mereka", "kita", "kami", "beliau", "engkau", "kalian", "yang",
    "dan", "di", "ke", "dari", "dalam", "untuk", "pada", "dengan", "oleh", "tentang", "mengenai", "terhadap",
    "hingga", "sampai", "sejak", "selama", "antara", "bersama", "tanpa", "kecuali", "selain", "adalah", "akan",
    "dapat", "bisa", "mampu", "harus", "mesti", "perlu", "ingin", "mau", "hendak", "sedang", "telah", "sudah",
    "belum", "pernah", "sering", "jarang", "selalu", "kadang", "biasa", "atau", "juga", "ini", "itu", "tersebut",
    "seperti", "karena", "sebab", "akibat", "sehingga", "bahwa", "jika", "kalau", "apabila", "bila", "ketika",
    "saat", "waktu", "tidak", "bukan", "jangan", "ada", "semua", "setiap", "masing", "beberapa", "banyak", "sedikit",
    "lebih", "kurang", "paling", "sangat", "sekali", "cukup", "agak", "hampir", "kira", "sekitar", "satu", "dua",
    "tiga", "empat", "lima", "enam", "tujuh", "delapan", "sembilan", "sepuluh", "pertama", "kedua", "ketiga",
    "keempat", "lah", "kah", "tah", "pun", "nya",
)

# Word endings and beginnings the light stemmer takes off, longest first, fixed values.
SUFFIXES = ("kan", "nya", "lah", "kah", "an", "mu", "ku", "i")
PREFIXES = ("ber", "ter", "per", "mem", "men", "me", "pe", "se", "ke", "di")

# Stock phrases of academic Indonesian, fixed values.
ACADEMIC_PHRASES = (
    "penelitian ini", "hasil penelitian", "metode penelitian", "dalam penelitian", "latar belakang",
    "tujuan penelitian", "rumusan masalah", "tinjauan pustaka", "kerangka teori", "landasan teori", "kajian pustaka",
    "penelitian terdahulu", "studi literatur", "analisis data", "pengumpulan data", "teknik analisis",
    "instrumen penelitian", "populasi dan sampel", "teknik sampling", "uji validitas", "uji reliabilitas",
    "hasil dan pembahasan", "kesimpulan dan saran", "daftar pustaka", "berdasarkan hasil", "dapat disimpulkan",
    "menunjukkan bahwa", "hal ini menunjukkan", "sesuai dengan", "sebagaimana yang", "sebagaimana dikemukakan",
    "menurut pendapat", "berdasarkan teori",
)

# Queries users often send, encoded ahead of time, fixed values.
COMMON_QUERIES = (
    "machine learning", "data analysis", "sistem informasi", "aplikasi web", "database", "algoritma",
    "implementasi", "analisis data", "web application", "mobile app",
)

# The 32 punctuation signs of ASCII.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
