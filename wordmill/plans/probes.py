"""Terms that every query of a term filter also gets, besides those of the documents.

Their languages, scripts and patterns are the ones that the filters are for, so
that no filter is compared over terms that it leaves alone. They count 0 times.
Words whose lower case depends on more than a character (a dotted capital I, a
final sigma) are not among them: the engine that checks lowers them otherwise.
"""

from __future__ import annotations

#: By what they are for; words are separated by blanks.
_WORDS = """
Hello WORLD iPhone running quickly happiness Straße ÄPFEL naïve café résumé façade Œuvre ǅ ISPARTA ıl
O'Neil rock'n'roll l'avion L'Homme qu'il dell'arte d'Artagnan n-athair b'fhéidir h-úll tAthair nEireann Mary's dogs’ ’tis 'tis
I.B.M. U.S.A. e.g. a.b well-known hyphen- - co-op snake_case_name kebab-case-name camelCaseName PascalCase XMLHttpRequest getURL2 HTTPServer
#HashTag #openSource # @someone @a @ user@example.com first.last+tag@sub.example.org @@x not@mail visit:bob@x.io,ann@y.org
https://Example.com:443/a/b?x=1#f http://example.org ftp://files.example.net/pub :// mailto:x key=value =v k= a=b=c _key:x
192.168.0.1 10.0.0.255 8.8.8.8 256.1.1.1 2001:db8::1 550e8400-e29b-41d4-a716-446655440000
0 7 42 007 1,000 1,234,567.89 3.14 -5 +8 1e6 .5 5. ½ Ⅷ 0xFF 0x1f 0b1011 0o17 0x 1-10 5..9 3~4 10KB 2.5GiB 512b 90m 1h30m 45% 12.5%
1st 2nd 3RD 11th 21st 1ST st 200 301 404 500 999 1234 E1001 ERR-42 ORA_600 ERROR warn DEBUG v1.2.3 1.2.3-beta.1 MCMXCIV xiv IIII ABC
word|payload term|5 boost|2.5 |lead trail| a|b|c __DROP__x __KW__y _type:word _len:3 _boost:1 _mention:bob
sooooo cooool aaaa aabbcc bookkeeper mississippi x yy the of from idiot
２０２４ ＡＢＣ ｆｕｌｌ ｶﾀｶﾅ ١٢٣ १२३ ৪৫৬ ๑๒๓ аpple раypal Αlpha ⅱ ℝ ℓ ✓ 😀 ☀️ zero​width soft­hyphen ‎left‏ right‮x é ñ
ёлка Ёж подъезд книгами домов красивая делает время людей города машины синий народными
українські новини ності читання містами книжками великого
książkami domów wielkiego pisanie radości człowiek kobietami miasto drogi
գրքերի տներում քաղաքներից մարդկանց գեղեցիկ տունը
knjigama gradovima velikoga pisanje radosti ljudskog ženama kućica
knygomis namais didžiausias skaitymas vaikams miestuose gerumas
flickornas husens bilarna pojkar arbetande möjligheten större stads
majades raamatute linnasse lapsed tegemine ilusad koerte
knihami mestách radosti ženám pekného čítanie vlakom
mestih knjigami radost otrokom delanje velikega hišah
talossa autoilla kirjoina ihmisten taloksi poikien kalliolta
házakat emberekkel városban könyveknek barátokhoz kutyák lovat asztalon
husene bilers jentenes gutter barna arbeidet
ছেলেগুলি বইগুলো মানুষদের লোকেরা কাজের বাড়িতে তোমাকে ছবি বাঁড় পড়া
लड़कियों किताबें जाएंगे करता लड़का बातों क़लम पढ़ाई हिन्दी आॅफिस सन्त
کتابها دوستان بزرگترین مردی خانه‌های زیبا كتاب يار آخرین
hablaban casas luces franceses niños niñas canciones felices pez crisis libro
ragazzi amiche occhi belle grande studio veloce città pioggia
flores animais papéis lençóis nações mãos felizmente casinha cadeira bonitos professora portuguesa jovens
Häusern Kindern Blumen Autos schöne Frauen Müller Bücher Straßen laufend
ponies dogs buses boss glass cities houses shoes aloes
chevaux journaux maisons prix gaz nationales
dětem městech hradů ženami velkého otcův matčin lékařští psaní kámen
градовете книгата мъже овци празници добрия езици човекът жените
برنامج والكتاب بالمدرسة الطالبات كتابها مسلمون للناس ودرس معلمين أحمد إيمان مدرسةٌ ىـ
flickor bilar kvinnorna pojkarna lärare böckers
canções pães animais papéis anéis fósseis homens livros
کتێبەکان پیاوێک ماڵەکە دایکمان شارەکانی خوێندنەوە كوردستان
ಮನೆಗಳಲ್ಲಿ ಪುಸ್ತಕಗಳು ಮರಗಳಿಗೆ ಊರಿಂದ நாடுகளில் மரங்கள் வீட்டுக்கு அவனால் పుస్తకాలను ఇంటిలో మనుషులు
நான் ๆไทย ភាសាខ្មែរ བོད་ཡིག ᏣᎳᎩ שָׁלוֹם ספרים מלך ייִדיש Łódź ÅNGSTRÖM Ærø Öl șțŞŢ ţăşi čačak љубав ġħ
casas corazones camiones lápices tesis lunes voces autobuses reyes jerseys menús clubs ciudades bosques
bobalhões quilométricas comunismo belezas boataria
ανθρωποι αγελαδων βιβλιου ελεφαντεσ συνεχεισ οριζομαι
Robert Smith Knuth Schmidt Wright Phillips Thomas Macdonald Knight Peters Schwarz Rough Lough Whittle Czarny Strauss
"""

PROBES: tuple[str, ...] = tuple(dict.fromkeys([*_WORDS.split(), "two words", " padded ", "tab\tinside", "\x1b[31mred\x1b[0m", "e\u0301te\u0301", "abcdefghijklmnopqrstuvwxyz0123456789", ""]))
