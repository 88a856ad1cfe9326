"""Stop words by language.

Fixed values: the words whose removal defines the result, in the order of their lists.
"""

from __future__ import annotations

#: One list for each language, words parted by white space.
WORDS: dict[str, str] = {
    "afrikaans": """
aan af al as baie by daar dag dat die dit een ek en gaan geen hom het hoe hulle hy in is jou jy kan kom ma maar met my na nie nog nou of om ons op sal
se self so sy te toe uit van vir was wat wees wil wou wie deur elke haar hier hierdie hul meer mens niks onder oor per reeds saam sien sonder teenoor
ter tussen weer word alle
""",
    "amharic": """
እና ነው የ ከ ለ በ ስለ ወደ ላይ እንደ ሆኖ ነበር ይህ ያ እነ እሱ እሷ እኛ እነሱ አንድ ሁሉ ብዙ ሌላ ያለ ያለው ምን ማን የት መቼ ለምን እንዴት ግን ወይም ከዚያ ነገር ሲ ሲሆን ያም ይሆናል ሆነ ሆነም አሁን ብቻ እዚህ እዚያ ከሆነ
ድረስ በጣም ያህል ቢሆን ሁሉም ያላቸው ያለበት እንኳን ሆኗል ነበረ ወዘተ ጋር
""",
    "arabic": """
من ومن منها منه في وفي فيها فيه على عليها عليه هذا هذه ذلك تلك هل ما ماذا لماذا أي أية كيف أين متى كم حيث إن إذا لو حين كلما لما مما إما أما إلى حتى
عند مع بعد قبل خلال بين بعض كل جميع لن لم لا ليس ليست ليسوا لكن بل غير كان كانت كانوا يكون تكون يكونوا قد سوف لقد هو هي هم هن أنا نحن أنت أنتم أنتن ثم
أو أم و ف ب ل الذي التي الذين اللواتي اللائي عن فوق تحت أمام خلف حول ضد أن لأن كي عندما بينما حيثما هنا هناك هنالك الآن اليوم أمس غدا كثيرا قليلا جدا
فقط أيضا كذلك نعم ربما يا أيها أيتها تم يتم سيتم وقد ولا ولم ولن عليك عنه عنها أنه أنها إنه إنها لها له لهم لهن بها به بهم بهن فإن وإن ولكن ذات ذو ذي
هؤلاء أولئك مثل نفس معظم أغلب كأن لعل ليت إلا سوى عدا خلا أحد
""",
    "armenian": """
այդ այլ այն այս դու դուք եմ են ենք ես եք է էի էին էինք էիր էիք էր ըստ թ ի ին իսկ իր կամ համար հետ հետո մենք մեջ մի ն նա նաև նրա նրանք որ որը որոնք
որպես ու ում պիտի վրա և
""",
    "azerbaijani": """
a ancaq amma artıq az bax belə bir biri bu buna bundan bunlar bunu bunun burada böyük da daha dedi deyil digər dəfə edən etdi etmək edir elə ən gərək
hər həm həmin hətta heç ilə indi isə ki kim kimi lakin mən nə nəyi o olan oldu olmaq olub ona ondan onlar onu onun ora orada öz sən sonra tək üçün var
yalnız yox və ya yəni
""",
    "basque": """
al anitz arabera asko baina bat batean batek bati batzuei batzuek batzuetan batzuk bera beraiek berau berauek bere berori beroriek beste bezala da
dago dira ditu du dute edo egin ere eta eurak ez gainera gu gutxi guzti haiei haiek haietan hainbeste hala han handik hango hara hari hark hartan hau
hauei hauek hauetan hemen hemendik hemengo hi hona honek honela honetan honi hor hori horiei horiek horietan horko horra horrek horrela horretan horri
hortik hura izan ni noiz nola non nondik nongo nor nora ze zein zen zenbait zenbat zer zergatik ziren zituen zu zuek zuen zuten
""",
    "bengali": """
এই ও থেকে করে এ না ওই এক্ নিয়ে করা বলেন সঙ্গে যে এব তা আর কোনো বলে সেই দিন হয় কি দু পরে সব দেওয়া মধ্যে এর সি শুরু কাজ কিছু কাছে সে তবে বা বন আগে জ্নজন
পি পর তো ছিল এখন আমরা প্রায় দুই আমাদের তাই অন্য গিয়ে প্রযন্ত মনে নতুন মতো কেখা প্রথম আজ টি ধামার অনেক বিভিন্ন র হাজার জানা নয় অবশ্য বেশি এস কে হতে বি
কয়েক সহ বেশ এমন এমনি কেন কেউ নেওয়া চেষ্টা লক্ষ বলা কারণ আছে শুধু তখন যা এসে চার যদি আবার কোটি উত্তর সামনে উপর বক্তব্য এত প্রাথমিক উপরে প্রতি কাজে যখন
খুব বহু গেল পেয়্র্ চালু ই নাগাদ থাকা পাচ যাওয়া রকম সাধারণ কমনে
""",
    "brazilian": """
a ainda alem ambas ambos antes ao aonde aos apos aquele aqueles as assim com como contra contudo cuja cujas cujo cujos da das de dela dele deles
demais depois desde desta deste dispoe dispoem diversa diversas diversos do dos durante e ela elas ele eles em entao entre essa essas esse esses esta
estas este estes ha isso isto logo mais mas mediante menos mesma mesmas mesmo mesmos na nas nao nem nesse neste no nos o os ou outra outras outro
outros pelas pelo pelos perante pois por porque portanto proprio proprios quais qual qualquer quando quanto que quem quer se seja sem sendo seu seus
sob sobre sua suas tal tambem teu teus toda todas todo todos tua tuas tudo um uma umas uns
""",
    "bulgarian": """
а аз ако ала бе без беше би бил била били било близо бъдат бъде бяха в вас ваш ваша вашe все всеки всички всичко всяка във въпреки върху г ги главно
го д да дали до докато докога дори досега доста е едва един ето за зад заедно заради засега защо защото и из или им има имат иска й каза как каква
какво както какъв като кога когато което които кой който колко която къде където към ли м ме между мен ми мнозина мога могат може моля му н на над
назад най направи напред например нас не него нея ни ние никой нито но някои някой няколко няма обаче около освен особено от отгоре отново още пак по
повече повечето под поне поради после почти прави пред преди през при пък първо с са само се сега си скоро след сме според сред срещу сте съм със също
т тази така такива такъв там твой те тези ти то това тогава този той толкова точно трябва тук тъй тя тях у харесва ч че често чрез ще щом я
""",
    "catalan": """
a abans ací ah així això al als aleshores algun alguna algunes alguns alhora allà allí allò altra altre altres amb ambdós ambdues apa aquell aquella
aquelles aquells aquest aquesta aquestes aquests aquí baix cada cadascú cadascuna com contra d dalt de del dels des després dins dintre donat doncs
durant e eh el els em en encara ens entre era eren es és esta està estaven et etc ets fins fora gairebé ha han has havia he hem heu hi ho i igual
iguals ja la les li llavors ma mal malgrat mateix mateixa me mentre més meu meus meva meves molt molta moltes molts mon mons na ne ni no només
nosaltres nostra nostre nostres o oh oi on pas pel pels per però perquè poc poca pocs potser propi qual quals quan quant que què quelcom qui quin
quina quines quins sa sem sense ser ses seu seus seva seves si sobre sobretot sol sols son són sons sota sou ta tal també tampoc tan tant tanta tantes
teu teus teva teves ton tons tot tota totes tots un una unes uns us va vaig vam van vas veu vosaltres vostra vostre vostres
""",
    "chinese": """
的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 吗 什么 那 又 被 从 把 那个 但 为 还 已 已经 而 且 及 或 对 中 与 只 所 以 之 将 因 于 则 乃 其 若 虽 然 仍 啊 呢 吧 嗯 哦 啦 哈
呀 么 哪 如 几 这个 那些 这些 怎么 哪里 谁
""",
    "cjk": """
的 了 和 是 就 都 而 及 与 着 或 一个 没有 我们 你们 他们 它们 她们 这 那 之 也 不 在 人 有 我 他 这个 那个 上 们 来 到 说 国 中 会 对 这些 它 以 时 个 为 要 么 能 可以 被 从 把 将 其 给 由 所 很 又 但 去 最 如 自 已 她 大 多 里 等
做 下 你 应 比 同 当 让 全 间 因 向 才 内 各 看 则 更 再 使 本 此 の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ
これ により おり より による ず なり られる において ば なかっ なく しかし について せ だっ できる それ ので でき つ における および いう さらに でも ら たり たち ます ん なら 이 그 저 것 수 등 들 및
""",
    "croatian": """
a ali bi bih bila bili bilo bio bismo biste biti blizu broj da do dok dva ga gdje god i ići ih ili ima iz ja je jedna jedne jedno jedan jer još ju k
ka kad kada kako kao koji koja koje koju kroz li me mene mi mimo moj moja moje mu na nad nakon nam nas naš naša naše ne nego neka neki nešto ni nije
nikoga nisam nismo niste nisu njega njegov njegova njegovo o od oko on ona oni ono osim ova ovaj ovo pa po pod poput prema pri sam sa samo se sebe si
smo ste su
""",
    "czech": """
a s k o i u v z dnes cz tímto budeš budem byli jseš můj svým ta tomto tohle tuto tyto jej zda proč máte tato kam tohoto kdo kteří mi nám tom tomuto
mít nic proto kterou byla toho protože asi ho naši napište re což tím takže svých její svými jste aj tu tedy teto bylo kde ke pravé ji nad nejsou či
pod téma mezi přes ty pak vám ani když však neg jsem tento článku články aby jsme před pta jejich byl ještě až bez také pouze první vaše která nás
nový tipy pokud může strana jeho své jiné zprávy nové není vás jen podle zde už být více bude již než který by které co nebo ten tak má při od po jsou
jak další ale si se ve to jako za zpět ze do pro je na atd atp jakmile přičemž já on ona ono oni ony my vy jí mě mne jemu tomu těm těmu němu němuž
jehož jíž jelikož jež jakož načež
""",
    "danish": """
og i jeg det at en den til er som på de med han af for ikke der var mig sig har et hun nu over da fra du ud sin dem os op man hans hvor eller hvad
skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette mit også under have dig anden hende mine alt
meget sit sine vor mod disse hvis din nogle hos blive mange ad bliver hendes været thi jer sådan
""",
    "dutch": """
de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij
ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen
moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest
andere
""",
    "english": """
a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with
""",
    "estonian": """
ja ei et ning on ka see mis ta aga kui oli siis seda oma selle veel kes nii pole tema kuid mida juba mille nagu olid üks olla olnud sest kogu kõik
mitte ise välja kus ette olema siin üle siia sinna ära nad me sa ees minu alla peal enne peale saab eest seal mina mil need kõige palju väga sama
jälle nende teda oled olen meil neil juurde kas midagi keegi mõni iga
""",
    "finnish": """
olla olen olet on olemme olette ovat ole oli olisi olisit olisin olisimme olisitte olisivat olit olin olimme olitte olivat ollut olleet en et ei emme
ette eivät minä minun minut minua minussa minusta minuun minulla minulta minulle sinä sinun sinut sinua sinussa sinusta sinuun sinulla sinulta sinulle
hän hänen hänet häntä hänessä hänestä häneen hänellä häneltä hänelle me meidän meidät meitä meissä meistä meihin meillä meiltä meille te teidän teidät
teitä teissä teistä teihin teillä teiltä teille he heidän heidät heitä heissä heistä heihin heillä heiltä heille tämä tämän tätä tässä tästä tähän
tallä tältä tälle tuo tuon tuota tuossa tuosta tuohon tuolla tuolta tuolle se sen sitä siinä siitä siihen sillä siltä sille nämä näiden näitä näissä
näistä näihin näillä näiltä näille nuo noiden noita noissa noista noihin noilla noilta noille ne niiden niitä niissä niistä niihin niillä niiltä
niille kuka kenen kenet ketä kenessä kenestä keneen kenellä keneltä kenelle mikä minkä mitä missä mistä mihin millä miltä mille joka jonka jota jossa
josta johon jolla jolta jolle joiden joita joissa joista joihin joilla joilta joille ja sekä että mutta kun niin kuin koska jos vaan vai eli tai
""",
    "french": """
au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes mon ne nos notre nous on ou par pas pour qu que qui
sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l à m n s t y été étée étées étés étant étante étants étantes suis es est sommes
êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois
soit soyons soyez soient fusse fusses fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai auras aura
aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse
eusses eût eussions eussiez eussent
""",
    "galician": """
a aínda alí aquel aquela aquelas aqueles aquilo aquí ao aos as así á ben cando che co coa comigo con connosco contigo convosco coas cos cun cuns cunha
cunhas da dalgunha dalgunhas dalgún dalgúns das de del dela delas deles desde deste do dos dun duns dunha dunhas e el ela elas eles en era eran esa
esas ese eses esta estar estaba está están este estes estiven estou eu é facer fora foram foron fun había hai iso isto la las lle lles lo los mais me
meu meus min miña miñas moi na nas neste nin no non nos nosa nosas noso nosos nós nun nunha nuns nunhas o os ou ó ós para pero pode pois pola polas
polo polos por que se senón seu seus sexa sido sobre súa súas tamén tan te ten teñen teño ter teu teus ti tido tiña tiven túa túas un unha unhas uns
vos vosa vosas voso vosos vós
""",
    "georgian": """
და არ ის რომ იყო ეს ერთ მე შენ ჩვენ ისინი მას მისი ჩემი შენი ჩვენი მათი რა ვინ სად როდის რატომ როგორ თუ მაგრამ ან არა ყველა კიდევ ძალიან ახლა აქ იქ ამ
იმ ასე ისე ზე შიგ ყოფა იყოს არის იქნა აქვს ჰქონდა გარდა მხოლოდ თავის მაშინ კი უკვე დროს
""",
    "german": """
aber alle allem allen aller allerdings alles also am an ander andere anderem anderen anderer anderes anderm andern anderr anders auch auf aus bei beim
bin bis bist da damit dann das dass daß dazu dein deine deinem deinen deiner dem den denn der des dessen dich die dies diese dieselbe dieselben diesem
diesen dieser dieses doch dort du durch ein eine einem einen einer einige einigem einigen einiger einiges einmal er es etwas euch euer eure eurem
euren eurer für gegen gewesen hab habe haben hat hatte hätte hier hin hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer im in indem ins ist jede
jedem jeden jeder jedes jedoch jenem jenen jener jenes jetzt kann kein keine keinem keinen keiner man manche manchem manchen mancher manches mein
meine meinem meinen meiner mich mir mit muss musste nach nachdem nicht nichts noch nun nur ob oder ohne sehr sein seine seinem seinen seiner seit
seitdem sich sie sind so sogar solch solche solchem solchen solcher soll sollte sondern sonst über um und uns unser unsere unserem unseren unserer
unter viel vom von vor während war warum was weil welch welche welchem welchen welcher welches wenn wer werde werden wie wieder will wir wird wo
wollen wollte würde würden zu zum zur zwar zwischen
""",
    "greek": """
ο η το οι τα του της των τον την και κι κ ειμαι εισαι ειναι ειμαστε ειστε στο στον στη στην μα αλλα απο για προς με σε ως παρα αντι κατα μετα θα να δε
δεν μη μην επι ενω εαν αν τοτε που πως ποιος ποια ποιο ποιοι ποιες ποιων ποιους αυτος αυτη αυτο αυτοι αυτων αυτους αυτες αυτα εκεινος εκεινη εκεινο
εκεινοι εκεινες εκεινα εκεινων εκεινους οπως ομως ισως οσο οτι
""",
    "hebrew": """
של רב פי עם עליו ע##  על עד מן מ##  לו ל##  לא כל כי יותר יש זה זאת את אשר אם אלה אל אך אין אחר אחד אז או אנחנו אני אתה אתם הוא היא היה היו הם הן הזה
הזאת היתה כך ככה כן כאן כמו כבר מי מה מאד למה לכן לפני מדוע מתי משהו עכשיו פה רק שוב שם תחת בין בגלל בעד בקרב ביותר בלי בו בה בהם גם דרך הנה ואילו ולא
זו מאחר עוד אף כמה שלו שלי שלך שלה שלנו שלהם
""",
    "hindi": """
अंदर अत अपना अपनी अपने अभी आदि आप इत्यादि इन इनका इन्हीं इन्हें इन्हों इस इसका इसकी इसके इसमें इसी इसे उन उनका उनकी उनके उनको उन्हीं उन्हें उन्हों उस
उसके उसी उसे एक एवं एस ऐसे और कई कर करता करते करना करने करें कहते कहा का काफ़ी कि किन्हें किन्हों किया किर किस किसी किसे की कुछ कुल के को कोई कौन
कौनसा गया घर जब जहाँ जा जितना जिन जिन्हें जिन्हों जिस जिसे जैसा जैसे जो तक तब तरह तिन तिन्हें तिन्हों तिस तिसे तो था थी थे दबारा दिया दुसरा दूसरे दो
द्वारा न नहीं ना निहायत नीचे ने पर परन्तु पहले पूरा पे फिर बनी बही बहुत बाद बाला बिलकुल भी भीतर मगर मानो में यदि यह यहाँ यही या यिह ये रखें रहा रहे
लिए लिये लेकिन व वर्ग वह वहाँ वहीं वाले वुह वे वग़ैरह संग सकता सकते सबसे सभी साथ साबुत सारा से सो ही हुआ हुई हुए है हैं हो होता होती होते होना होने
""",
    "hungarian": """
a ahogy ahol aki akik akkor alatt által általában amely amelyek amelyekben amelyeket amelyet amelynek ami amit amolyan amíg amikor az azok azon
azonban azután azzal azért be belül benne bár csak de e ebben eddig egy egész egyéb egyik egyre ekkor el elég ellen elő először előtt emilyen engem én
ennek erre ez ezek ezen ezt ezzel ezért fel felé hanem hiszen hogy hogyan igen így ill illetve inkább is itt jó jól jobban kell kellett keresztül ki
kis között közül legalább legyen lehet lett maga magát már más másik meg még mellett mert mi mikor milyen minden mindent mindenki mindig mint mintha
mivel mondta most nagy nagyobb nagyon ne nekem neki nem néha néhány nincs olyan ott pedig persze rá s saját sem semmi sok sokat sokkal számára szemben
szerint szinte talán tehát teljes tovább továbbá több úgy ugyanis új újabb újra után utána utolsó vagy vagyis valaki valami valamint való van vannak
volt voltak volna végig végül
""",
    "irish": """
a ach ag agus an aon ar arna as b ba beirt bhúr caoga ceathair ceathrar chomh chtó chuig chun cois céad cúig cúigear d daichead dar de deich deichniúr
den dhá do don dtí dá dár dó faoi faoin faoina faoinár fara fiche gach gan go gur haon hocht i iad idir in ina ins is le leis lena lenár m mar mo mé
na naoi naoínear ná ní nó nócha ocht ochtar os roimh sa seacht seachtar seisear siad sibh sin sinn siúd sna sé sí tar thar thú triúr trí trína trínár
tú á ár é éis í ó ón óna ónár
""",
    "japanese": """
の に は を た が で て と し れ さ ある いる も する から な こと として い や れる など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において ば なかっ なく
しかし について せ だっ それ あの ここ どの だけ でも けど ながら まだ ほど
""",
    "korean": """
가 가까스로 것 것과 거의 게다가 결국 고 곧 과 그 그래서 그러나 그러면 그런데 그리고 그중 까닭 까지 나 너 네 는 다 다시 대하여 더 더군다나 도 된 되어 둘 를 만약 만일 며 모든 못 무엇 및 바로 보다 아 아니 안 않 알 약간 어떤 에 에게 에서 여 와 우리
으로 을 의 이 이다 이런 인 일 자 잘 저 전 점 좀 중 즉 지 쪽 하 한 할
""",
    "latvian": """
aiz ap ar apakš ārpus augšpus bez caur dēļ gar iekš iz kopš labad lejpus līdz no otrpus pa par pār pēc pie pirms pret priekš starp šaipus uz viņpus
virs virspus zem apakšpus un bet jo ja ka lai tomēr tikko turpretī arī kaut gan tādēļ tā ne tikvien vien kā ir te vai kamēr diezin droši diemžēl nebūt
ik it taču nu pat tiklab iekšpus nedz tik nevis turpretim jeb iekam iekām iekāms kolīdz līdzko tiklīdz jebšu tālab tāpēc nekā itin jau jel nē nezin
tad tikai vis tak iekams
""",
    "lithuanian": """
aš tu jis ji mes jūs jie jos mano tavo jo mūsų jūsų jų šis šita tas ta anas ana kuris kuri kas koks kokia keleri kelerios keli kelios ir bei ar arba
bet kad kai kol nors nes jei jeigu negu o tačiau vis dėlto todėl iki per nuo po su be dėl į iš ant už prie apie pagal pas tarp prieš pro link taip ne
kur kaip kada kiek dabar čia ten labai dar jau tik net jog būti yra buvo bus būtų
""",
    "malay": """
ada adakah adalah adanya adapun agak akan akhir aku amat anda antara apa apakah atau bagi bahawa bahwa belum berada berapa bersama bisa boleh dan dari
dengan dia hal hampir harus hendak ia ini itu jadi jangan jika juga kami kamu kata ke kepada ketika lagi lain lalu maka masih mereka mungkin namun
pada para pernah pula pun saja sama satu saya se sebagai sedang sendiri seorang sesuatu sudah supaya tak tanpa telah tentang tidak tiap tiba untuk
yang
""",
    "marathi": """
आणि आहे एक करणे करत करून का काही किंवा की केला केले कोण गेला गेले घेऊन च जे झाला झाले ज्या तर तरी ता त्या त्याच्या त्यांना दिला ना नाही पण पर पासून
पुढे म्हणजे म्हणून मात्र मी या येथे ला व वर सर्व सुद्धा सह हा ही हे होता होती होते आता अशा आम्ही आपण उपर कधी कसे कुठे काय त्यांनी तुम्ही ते तो ती नंतर
मध्ये माझा माझी शी असे असा
""",
    "mongolian": """
а аль бас бид бол болно боловч бус бүх бүхий бүр бэ бөгөөд гэж гэсэн гэхдээ дээр зөвхөн ийм л миний мөн нь нэг та тэд тэр тэгэхэд учир ч чинь энэ
эсвэл юм юу байна байгаа байсан болж болсон боломж буюу гэдэг дотор зарим ингэж нэгэн ороход тухай тэгвэл тэнд харин хийж хэрвээ цаг ямар яг өмнө өөр
үед гэвч дор хэн ийн
""",
    "nepali": """
छ र पनि छन् को मा ले भने गरेको हो एक थियो यो गर्ने नै छैन भएको त्यो उनी उनले कुनै गर्न हुने अरू लागि सबै यस गरी के कसरी कहाँ कति तर वा अनि जब तब यदि
अर्को धेरै सँग मात्र बाट पछि अघि माथि तल भित्र बाहिर म तिमी ऊ हामी तिनी उसले मेरो तिम्रो उसको हाम्रो तिनको थिए छौ हुन्छ भयो गर्छ भन्ने जसले अब पहिले
""",
    "norwegian": """
og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt ha hadde hun nå over da ved fra du ut
sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blei blitt kunne inn når være kom noen noe ville dere deres kun ja
etter ned skulle denne for deg si sine sitt mot å meget hvorfor dette disse uten hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår
hver hvem vors hvis både bare vært færre gjøre sist begge
""",
    "persian": """
و در به از که این را با است برای آن یک خود تا کرد بر هم نیز گفت می شد هر یا اما باید دو اند هیچ دی شود وی شده بود دارد همه اگر پس ما چون نه حتی بی من
شدن هایی آنها بین کنند چه بلکه نیست ها همین ای کند آنان آور شوند دارند بوده گروه کننده شدند ندارد همان پیش او روی زیر باره کردن ولی چند شما گرفت داده
توان مورد بسیار نزد داشت چرا شان خواهد آید دیگر بخش کرده داد سوی خوب اول
""",
    "polish": """
ach aj albo bardzo bez bo być ci cię ciebie co czy daleko dla dlaczego dlatego do dobrze dokąd dość dużo dwa dwaj dwie dwoje dziś dzisiaj gdyby gdzie
go ich ile im inny ja jak jakby jaki je jeden jedna jedno jego jej jemu jest jestem jeszcze jeśli jeżeli już każdy kiedy kierunku kto ku który lecz
lub ma mają mam mi mną mnie mogę może mu musi my na nad nam nami nas nasi nasz nasza nasze natychmiast nią nic nich nie niego niej niemu nigdy nim
nimi niż no o obok od około on ona one oni ono owszem pan pana pani po pod podczas pomimo ponad ponieważ powinien powinna powinni powinno poza prawie
przecież przed przede przeze przez przy roku również sam sama się skąd sobie sobą sposób swoje ta tak taka taki tam te tego tej ten to tobą tobie tu
tutaj twoi twoja twoje twój ty tych tylko tym u w wam wami was wasz wasza wasze we więc wszystko wtedy wy z za zawsze ze że żeby
""",
    "portuguese": """
a ao aos aquela aquelas aquele aqueles aquilo as até com como da das de dela delas dele deles depois do dos e ela elas ele eles em entre era eram essa
essas esse esses esta estas este estes eu foi fomos for fora foram forem formos fosse fossem fui há isso isto já lhe lhes lo mais mas me mesmo meu
meus minha minhas muito na nas nem no nos nós nossa nossas nosso nossos num numa não o os ou para pela pelas pelo pelos por qual quando que quem se
seja sejam sejamos sem ser será serão seria seriam seu seus sob somos sou sua suas são só também te tem temos tenho ter teu teus ti tinha tinham toda
todas todo todos tu tua tuas tudo um uma umas uns você vocês vos vossa vossas vosso vossos
""",
    "romanian": """
acea aceasta această aceea acei acel acela acele acelea acest acesta aceste acestea aceşti aceştia acolo acum ai aia aibă aici al ala ale alea altceva
altcineva am ar are aş aşadar asemenea asta astăzi astea asupra aţi au avea avem aveţi azi bine bucur bună ca că căci când care cărei căror cărui cât
câte câţi către câtva ce cel ceva chiar cine cineva cît cîte cîţi cîtva contra cu cum cumva curând da dă dacă dar datorită de deci deja deoarece
departe deşi din dinaintea dintre drept după ea ei el ele eram este eşti eu face fără fi fie fiecare fii fim fiţi iar ieri îi îl îmi împotriva în
înainte înaintea încât încît încotro între întrucât întrucît îţi la lângă le li lîngă lor lui mă mâine mea mei mele mereu meu mi mine mult multă mulţi
ne nicăieri nici nimeni nişte noastră noastre noi noştri nostru nu ori oricând oricare oricât orice oricine oricît oricum oriunde până pe pentru peste
pînă poate pot prea prima primul prin sa să săi sale sau său se şi sînt sîntem sînteţi spre sub sunt suntem sunteţi ta tăi tale tău te ţi ţie tine
toată tot toţi totuşi tu un una unde undeva unei unele uneori unor vă vi voastră voastre voi voştri vostru vouă vreo vreun
""",
    "russian": """
и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только её мне было вот от меня ещё нет о из ему теперь когда даже ну
вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там потом себя ничего ей может они тут где есть надо ней для мы тебя их чем
была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее
сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая много разве три эту
моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им более всегда конечно всю между
""",
    "serbian": """
и у не да је на за се од са су то ће би по али као који све њих између тај нас овде сви они или тога бити јер ова мој ово још него тако ми ако нешто
има када сад његов само њен ти што мене већ неко где док пре после око ту овај био та из те ни нити без како иако своје
""",
    "slovak": """
a aby aj ak ako ale alebo ani áno asi až bez bude budem budeš budeme budete budú by bol bola boli bolo buď cez čo či ďalší do ho ešte i ich iný ja je
jeho jej jemu ju k kam každý kde keď kto ktorá ktoré ktorí ktorý ku lebo len ma mať má medzi mi mne mnou moja moje môj môže my na nad nám nás náš naša
naše naši ne nech nejaký nie niečo niekde niekomu niektorí nič o od on ona oni ono po pod podľa pokiaľ potom práve pre prečo pred pri s sa si so som
sú ta tak takže tam táto ten to toho tom tú túto ty už v vám váš vo vy z za zo že
""",
    "slovenian": """
a ali ampak bi bil bila bile bili bilo biti blizu bo bodo bom boš bova brez da do dokler ga ge i in iz ja jaz je ji jih jim jo kaj kakor kam kdaj kdo
ker ki ko kot le li me med mene mi midva na nad nam nas naš naša naše ne nek nekdo ni nič niso njega njegov njegova njegovo o ob od on ona one oni ono
oziroma pa po pod potem pred pri s saj sam sama se sebe sem si smo so ste ta tudi že
""",
    "sorani": """
و لە کە ی لەگەڵ بۆ ئەو ئەم بە ئەوەی سەر دوو هەروەها لەو دەکات چەند هەر من ئێمە تۆ ئێوە ئەوان پێ بەبێ دە تێ دەگەڵ دوای جگە لێ لەبەر لەبارەی لەبن لەدەم
لەناو لەنێو لەپێناوی لەرێگا لەسەر لەژێر ناو نێوان پاش پێش وەک بەلام هەتا کەچی بەڵام ئایا بەلای لەلایەن
""",
    "spanish": """
a al algo algunas algunos ante antes como con contra cual cuando de del desde donde durante e el ella ellas ellos en entre era esa esas ese eso esos
esta estaba estado estar estas este esto estos fue ha hasta hay la las le les lo los más me mi mía mías mientras muy mío mí míos nada ni no nos
nosotras nosotros nuestra nuestras nuestro nuestros o os otra otras otro otros para pero por que quien se ser si sin sino sobre somos son soy su sus
suya suyas suyo suyos también te ti tiene todas todo todos tu tus tuya tuyas tuyo tuyos tú un una unas uno unos usted ustedes vosotras vosotros
vuestra vuestras vuestro vuestros y ya yo él éramos
""",
    "swahili": """
akasema alikuwa alisema au baada basi bila cha chini hadi hapo hata hii hiyo hizo huku huo huyu ili ilikuwa juu kama karibu katika kila kisha kufanya
kuhusu kuja kwa kwamba kwenda kwenye la lakini mara mdogo mengi mimi mkubwa moja mpaka mwenye na naye ndani ng ni nini pamoja pia sana sasa sisi tangu
tena tu vile wa wakati wao watu wewe ya yake yangu yao yeye yule za zaidi zake huyo ile
""",
    "swedish": """
och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke inte ing dig mig min mitt ha hans hennes sin sina sitt
vara vi vid vad vars utan vilka ni er era ert skulle nu man inga inget hur vilken vilket deras dem denna denne detta dessa upp efter dag alla under
just ut genom får då mot något sedan från andra kan nog mellan mycket blir bli blev har där här gör göra helt redan hela också egen samt kommer
""",
    "tagalog": """
akin aking ako alin am amin aming ang ano anumang apat at atin ating ay bababa bago bakit bawat bilang dahil dalawa dapat din dito doon gagawin
gayunman ginagawa ginawa gusto habang hanggang hindo huwag iba ibaba ibabaw ibig ikaw ilagay ilalim ilan inyong isa isang itaas ito iyo iyon iyong ka
kami kanila kanilang kanino kanya kanyang kapag kasama kay kaysa ko kong kulang kung laban lahat lamang lang maaari mga na namin
""",
    "tamil": """
அந்த அது அல்லது அவர் அவன் அவள் ஆகிய ஆனால் இங்கு இது இந்த இருக்க இருந்து இல்லை உள்ள உன் எந்த எல்லா என் என்ன என்று ஒரு ஒவ்வொரு கொண்டு சில தான் நான் நீ
நீங்கள் பல பற்றி போது மற்றும் மிக மீது முன் யார் வரை வேண்டும் அங்கு அதன் அவர்கள் ஆகும் ஆம் இங்கே இவர் உடன் எப்படி எனது கீழ் மேல் விட செய்ய போல்
அப்போது ஏன் கூட தன் மட்டும் அவை
""",
    "thai": """
ไว้ ไม่ ไป ได้ ให้ ใน โดย แห่ง แล้ว และ แรก แบบ แต่ เอง เห็น เลย เริ่ม เรา เมื่อ เพื่อ เพราะ เป็นการ เป็น เปิดเผย เปิด เนื่องจาก เดียวกัน เดียว เช่น
เฉพาะ เคย เข้า เขา อีก อาจ อะไร ออก อย่าง อยู่ หาก หลาย หลังจาก หลัง หรือ หนึ่ง ส่วน ส่ง สุด สำหรับ ว่า วัน ลง ร่วม ราย รับ ระหว่าง รวม ยัง มี มาก มา
พร้อม พบ ผ่าน ผล บาง น่า นี้ นำ นั้น นัก นอกจาก ทุก ที่สุด ที่ ทำให้ ทำ ทาง ทั้งนี้ ทั้ง ถ้า ถูก ถึง ต้อง ต่างๆ ต่าง ต่อ ตาม ตั้งแต่ ตั้ง ด้าน ด้วย
ดัง ซึ่ง จึง จาก จัด จะ คือ ความ ครั้ง คง ขึ้น ของ ขณะ ก่อน ก็ การ กับ กัน กว่า กล่าว
""",
    "turkish": """
acaba ama ancak arada aslında ayrıca bana bazı belki ben benden beni benim beri bile bir birçok biri birkaç birşey biz bize bizden bizi bizim böyle
böylece bu buna bunda bundan bunlar bunları bunların bunu bunun burada çok çünkü da daha dahi de defa değil diğer diye dolayı dolayısıyla dört edecek
eden ederek edilecek ediliyor edilmesi ediyor eğer en gibi göre halen hangi hatta hem henüz hep hepsi her herhangi herkesin hiç hiçbir için iki ile
ilgili ise işte itibaren kadar karşın kendi kendilerine kendini kendisi kendisine kendisini kez ki kim kimden kime kimi kimse mu mü mı nasıl ne neden
nedenle nerde nerede nereye niye niçin o olan olarak oldu olduğu olduğunu olmadı olmadığı olmak olması olmayan olmaz olsa olsun olup olur olursa
oluyor on ona ondan onlar onlardan onları onların onu onun oysa öyle pek rağmen sadece sanki sen senden seni senin siz sizden sizi sizin şey şeyi
şeyler şöyle şu şuna şunda şundan şunları şunu tarafından tüm üç üzere var vardı ve veya ya yani yapacak yapılan yapılması yapıyor yaptı yaptığı
yaptığını yaptıkları yerine yine yoksa zaten
""",
    "ukrainian": """
а або але б без би біля більш бо був була було були бути в від він вона вони воно все вже де для до добре дуже е є ж з за зі і й із коли ми між може
можна мої на навіть нам нас не ні ніж ну о по під після при про та так також там те теж тепер ти то тут у це цей що
""",
    "urdu": """
آئے آج آخر آپ اب اپنا اپنی اپنے ادھر اس اسی اگر ان انہوں اور بات بالکل بجائے بعد بلکہ بھی بہت تب تر تم تمام تو تک ثابت جا جب جن جو حالانکہ خود دو
دوران رہا رہے سا سب سے صرف طرح طور عین کا کبھی کر کرتا کرنا کرنے کسی کل کم کو کوئی کچھ کہ کی کیا گا لئے لیکن مجھ مجھے میں نا نہ نہیں نے والے وہ ہم ہو
ہوئے ہیں یا یہ
""",
    "vietnamese": """
bị bởi cả các cái cần càng chỉ chiếc cho chứ chưa chuyện có có_thể cơ cùng cũng của da dù dưới đã đang đây để đến đều điều do đó được gì hay hoặc họ
khi không là lại lên lúc mà mỗi một một_cách này nên nếu ngay nhiều như nhưng những nơi nữa phải qua ra rất rằng rồi sau sẽ so sự tại theo thì trên
trong trước từ từng và vẫn vào vậy vì việc với vừa tôi bạn anh ấy em nó chúng chúng_tôi chúng_ta mình hơn thế đấy đâu ai
""",
}
# Italian and Indonesian have lists of over two hundred words, which callers give
# to the stop filter as a parameter.


def stop_words(language: str) -> tuple[str, ...]:
    """The list of a language, also as _language_; filipino is tagalog. KeyError for others."""
    name = language.strip("_").lower()
    return tuple(WORDS[{"filipino": "tagalog"}.get(name, name)].split())


def supported_languages() -> tuple[str, ...]:
    return tuple(WORDS)
