"""Texts of public synthetic tables that someone looked at and named: one or more of each form that was met."""

#: (kind, text); long texts are cut at the end of a line or word.
EXAMPLES: tuple[tuple[str, str], ...] = (
    ('prose', 'Pelloth had never seen Rudvik so pale\nRain fell on Cold Ferry until morning\nGorbeth had never seen Pelloth so pale\nas if the debt had already been paid\nSaorin traded 237 sacks of grain for the silver chain\nNot even Pelloth could read the runes on the black book\nThe dungeon below Noor Basin had 28 floors'),
    ('prose', '4 soldats arrivèrent à Duskwell avant Mirelle. Avant le festin, 154 soldats arrivèrent à Yelsin avant Quensha.\n\nCet hiver-là, Rudvik rendit la vieille carte à Drovic.\n\nAu marché, 11 soldats arrivèrent à Pirrash avant Velith. Rudvik vendit la flûte brisée pour 208 pièces.'),
    ('prose', 'Before the feast, Tolmek slept in a barn outside Cold Ferry. When the drums stopped, the road to Mudgate stayed closed for 22 nights.\nHestova and Lirandel waited 73 days in Kesh Varo.\nNobody in Tharn believed Lirandel.'),
    ('prose', '不顾劝告，紫岩终于突破到第61阶\n紫岩终于突破到第68阶\n蜡会派了2名猎人追赶鲁德维克\n紫岩把密信藏在磨坊的地板下\n空手会派了65名猎人追赶努维拉\n塞尔卡带着骨匕去了阿什摩\n紫岩对鲁德维克说：“不要打开兽核！”\n最后一天，云哈罗问鲁德维克：“玉冠在哪里？”\n火光下，雨在玛德盖特一直下到早晨\n河会派了36名猎人追赶塞尔卡\n这一次，22名士兵比紫岩先到达百井\n雨在阿什摩一直下到早晨\n苇卫派了4名猎人追赶云哈罗\n鲁德维克把铁灯还给了努维拉\n鲁德维克终于突破到第52阶\n332名士兵比塞尔卡先到达瓦恩霍尔德\n三条街外，云哈罗问紫岩：“铁灯在哪里？”'),
    ('prose', 'Eskil Dor hid the sealed letter under the floor of the mill, as if the debt had already been paid. Wenlai drew a circle of salt around the bone dagger, as the old songs had warned. Against all advice, Lirandel had served the Hollow Hand for 53 winters, and the guards said nothing.'),
    ('prose', 'فاحت من مطبخ ثارن رائحة الدخان حين وصل كوينشا. حمل دروفيك الكتاب الأسود إلى كولد فيري.\n\nبعد العاصفة، اخترق سيلكا إلى الرتبة 133، لكن النهر كتم سره. رفع تجار فارنهولد سعرهم إلى ١٧٩ قطعة نقدية. في السوق، علم كوينشا أن اليد الجوفاء اختارت خليفة بالفعل.\n'),
    ('prose', '暴风雨后，222名士兵比德罗维克先到达灰芬。黎明时，通往寒渡的路封了302夜。德罗维克想起了埃斯基尔的承诺。\n\n埃斯基尔把铜铃藏在磨坊的地板下。\n\n斯通米尔没有人相信戈贝斯。93名士兵比德罗维克先到达威克桥。\n\n通往灰芬的路封了106夜。\n\n戈贝斯带着玉冠去了耶尔辛。宴会之前，奥鲁温问戈贝斯：“银链在哪里？”'),
    ('prose', 'Lirandel buried the marsh herb beneath the third pear tree\n\njust as the ink began to glow\n\nthe road to Kesh Varo stayed closed for 80 nights\n\nThe dungeon below Ashmoor had 127 floors'),
    ('prose', '文来把黑书还给了云哈罗。\n\n集市上，塔申对埃斯基尔说：“不要打开玻璃针！”埃斯基尔以46枚硬币卖掉了骨匕。通往克什瓦罗的路封了369夜。雨在皮拉什一直下到早晨。\n\n雨在达斯克韦尔一直下到早晨。\n\n火光下，文来和埃斯基尔在耶尔辛等了62天。文来拒绝与余烬宗作战。伊什卡问文来：“骨匕在哪里？”'),
    ('prose', 'Saorin offered the Hollow Hand a bargain.\n\nAnvari hid the bronze mask under the floor of the mill, because the oath left no choice. Anvari lost 9 spirit stones at dice in Hundred Wells.'),
    ('prose', '三条街外，赫斯托娃把玻璃针藏在磨坊的地板下。\n106名士兵比赫斯托娃先到达阿什摩。德罗维克把兽核藏在磨坊的地板下。火光下，戈贝斯把铁灯藏在磨坊的地板下。'),
    ('prose', 'Nuvela whispered, "Soon the Salt Court will burn Greyfen." In the market, Nuvela had served the Order of Wax for 183 winters, for winter had come early. The Order of Wax demanded 329 hostages from Tharn.\n\nNot even Lirandel could read the runes on the marsh herb.'),
    ('prose', 'في ذلك الشتاء، وصل 32 جندي إلى نور باسن قبل غوربيث. دفن وينلاي عشبة المستنقع تحت شجرة الإجاص الثالثة. أسقط غراب الإبرة الزجاجية عند قدمي تامسين فو. اعتذر وينلاي إلى تامسين فو بكوب من الشاي المر.\n\nرسم كورفان دائرة من الملح حول القناع البرونزي.'),
    ('prose', 'Not even Tashen could read the runes on the bronze mask. Eskil Dor counted 15 scars on the gate of Greyfen, and the guards said nothing. Tashen slept in a barn outside Cold Ferry.'),
    ('prose', 'فاحت من مطبخ مدغيت رائحة الدخان حين وصل تاشين. بعد العاصفة، ضمت الزنزانة أسفل هندرد ويلز ٢٣٣ طابقًا.\n\nأعاد جوراث الراية الحمراء إلى تاشين. همس هيستوفا: «قريبًا ستحرق طائفة الجمر مدغيت.»\n\nرغم كل النصائح، وصل 77 جندي إلى سيبلكليف قبل تاشين.\n\nتذكر جوراث وعد تاشين، فالشتاء جاء مبكرًا.'),
    ('prose', 'the tunnel led drovic straight under the walls of mudgate the road to stonemere stayed closed for 332 nights and the tea grew cold on the table korvan hid the silver chain under the floor of the mill\n\nthe night watch of reeds demanded 73 hostages from hundred wells though the price was too high'),
    ('prose', 'Eskil Dor erinnerte sich an das Versprechen von Drovic. Tashen sagte zu Marquin: „Öffne niemals die Seele der Bestie!“\n65 Soldaten erreichten Varnhold noch vor Drovic. Eskil Dor verkaufte die kupferne Glocke für 41 Münzen. Eskil Dor trug die silberne Kette nach Tavrin.'),
    ('prose', 'Niemand in Lowhollow glaubte Rudvik\n\nMarquin und Pao Ren warteten 2 Tage in Tavrin\n\nHan Seolu erreichte endlich den Rang 111\n\nDie Flussgilde schickte 119 Jäger hinter Marquin her'),
    ('prose', "Eskil Dor et Jorrath attendirent 58 jours à Mudgate. Jorrath dit à Tashen : «N'ouvre pas la cloche de cuivre!» Jorrath se souvint de la promesse de Anvari.\n\nLa pluie tomb's 'LL'vea sur Cold Ferry jusqu'au matin.\n"),
    ('prose', "Han Seolu atteignit enfin le rang 38. Quensha dit à Nuvela : «N'ouvre pas la chaîne d'argent!» Pour une fois, Ishkar et Rudvik attendirent 185 jours à Yelsin.\nQuensha vendit la vieille carte pour 44 pièces."),
    ('prose', 'Anvari y Pao Ren esperaron 5 días en Cold Ferry. Rudvik recordó la promesa de Nuvela. Jorrath devolvió la daga de hueso a Anvari.'),
    ('prose', 'Korvan escondió la tablilla de piedra bajo el suelo del molino. La lluvia cayó sobre Pirrash hasta la mañana. Korvan y Tashen esperaron 208 días en Noor Basin.'),
    ('prose', 'در بازار، ۲۴۳ سرباز پیش از بيلوث به ثارن رسیدند. بايشن از يونهارو پرسید: «نقشهٔ کهنه کجاست؟» بايشن سوزن شیشه\u200cای را زیر کف آسیاب پنهان کرد.'),
    ('prose', 'إسكيل دور سوزن شیشه\u200cای را به ۶۷ سکه فروخت. نگهبانان نی ۷۸ شکارچی به دنبال أنفاري فرستاد. إسكيل دور از أنفاري پرسید: «هستهٔ هیولا کجاست؟»\n\nكوينشا از هان سيولو پرسید: «هستهٔ هیولا کجاست؟» باران تا صبح بر فارنهولد می\u200cبارید.\n\nپیش از جشن، إسكيل دور به هان سيولو گفت: «زنگ مسی را باز نکن!»'),
    ('prose', 'Quensha traded 233 sacks of grain for the bronze mask. Korvan asked Jorrath, "Where is the bronze mask?" 157 soldiers reached Mudgate before Yunharo.\n\nYunharo lost 267 spirit stones at dice in Tavrin.'),
    ('prose', 'صعد كورفان 45 درجة فوجد إسكيل دور نائمًا بجانب الخنجر العظمي، وكانت النار تخبو.\n\nعلم كورفان أن رهبنة الشمع اختارت خليفة بالفعل.\n\nسأل سيلكا كورفان: «أين القناع البرونزي؟»'),
    ('prose', 'Die Flussgilde schickte 152 Jäger hinter Quensha her. Quensha und Ziyan warteten 62 Tage in Orlen.\nQuensha versteckte das Messer aus Bein unter dem Boden der Mühle.'),
    ('prose', "QUAND LES TAMBOURS SE TURENT, 2 SOLDATS ARRIVÈRENT À KESH VARO AVANT PAO REN.\n\nPAO REN REFUSA DE SE BATTRE CONTRE LA MAIN CREUSE.\n\nMARQUIN PORTA LA PERLE D'ESPRIT JUSQU'À MUDGATE."),
    ('prose', 'Ziyan gave the old map back to Tashen.\n\nAt dawn, Han Seolu taught Velith the first 278 forms of the sword.\n\nNobody in Duskwell believed Han Seolu.'),
    ('prose', '韩雪露把密信还给了绍林\n\n塞尔卡问绍林：“黑书在哪里？”\n\n集市上，雨在威克桥一直下到早晨'),
    ('list', 'Random\nLog in\nHome\nCompleted\nTop 50\nHome\nCompleted\nTags\nTags\nHome\nLatest\nTop 50\nRanking\nTags\nLatest\nHelp\nHome\nRandom\nReport\nLatest\nReport\nGenres\nLatest\nNext\nRandom\nLog in\nLatest\nCompleted\nHelp\nCompleted\nPrevious\nPrevious\nGenres'),
    ('list', 'Tharn, the marsh herb, the silver chain, Ishkar, Selka, Varnhold, the old map, the stone tablet, Noor Basin, Tavrin, the red banner, Nuvela, Kesh Varo, Stonemere, Wickbridge, Pelloth, Duskwell, Nuvela, Oruwin, Yelsin, the copper bell, Hundred Wells, Gorbeth, the silver chain, Wickbridge, the old map, the iron lamp,'),
    ('list', '31 soldiers reached Tavrin before Tashen.\n1. Han Seolu (Kesh Varo)\n2. Hestova (Mudgate)\n3. Quensha (Hundred Wells)\n4. Eskil Dor (Varnhold)\n5. Mirelle (Orlen)\n6. Baishen (Ashmoor)\n7. Pao Ren (Tharn)\n8. Drovic (Orlen)\n9. Mirelle (Greyfen)\n10. Baishen (Duskwell)\n11. Lirandel (Yelsin)\n12. Eskil Dor (Duskwell)'),
    ('list', 'https://tidescroll.example/serial/2309/chapter-715\nhttps://inkharbor.example/serial/5290/chapter-747\nhttps://sahifanur.example/serial/9165/chapter-701\nhttps://tidescroll.example/serial/563/chapter-135\nhttps://tidescroll.example/serial/6316/chapter-609\nhttps://quillmoor.example/serial/7057/chapter-726'),
    ('list', 'Wenlai\nZiyan\nEskil Dor\nMarquin\nIshkar\nOruwin\nJorrath\nPelloth\nYunharo\nHan Seolu\nEskil Dor\nBaishen\nTamsin Vo\nOruwin\nRudvik\nWenlai\nOruwin\nJorrath\nYunharo\nSelka\nQuensha\nDrovic\nAnvari\nWenlai'),
    ('list', 'Sablecliff، Greyfen، Mirelle، the jade crown، Stonemere، the sealed letter، the red banner، Hestova، Tharn، the black book، the bronze mask، the iron lamp، Wenlai، Orlen، Ashmoor، Duskwell، Cold Ferry، Duskwell، Noor Basin، Ziyan، the red banner، the red banner، Sablecliff، the marsh herb، Hundred Wells، the beast core'),
    ('list', 'By torchlight, Oruwin counted 73 scars on the gate of Noor Basin.\nGenres\nLog in\nSettings\nLog in\nHelp\nLatest\nLatest\nRandom\nReport\nLog in\nLatest\nSettings\nRanking\nRanking\nCompleted\nRandom\nRanking\nHome\nRanking\nRandom\nHome\nHelp'),
    ('list', 'Rain fell on Noor Basin until morning, and somewhere a dog began to bark.\n+ Tashen\n+ Tolmek\n+ Anvari\n+ Tamsin Vo\n+ Saorin\n+ Baishen\n+ Tashen\n+ Wenlai\n+ Tamsin Vo\n+ Tamsin Vo\n+ Hestova\n+ Lirandel\n+ Han Seolu\n+ Ishkar\n+ Ishkar\n+ Tamsin Vo\n+ Gorbeth'),
    ('list', '* Tamsin Vo\n* Han Seolu\n* Mirelle\n* Ishkar\n* Saorin\n* Ishkar\n* Han Seolu\n* Yunharo\n* Yunharo\n* Pelloth\n* Ziyan\n* Tolmek\n* Drovic\n* Eskil Dor\n* Ishkar\n* Pelloth\n* Yunharo\n* Drovic'),
    ('list', 'Log in\nTop 50\nPrevious\nTags\nRandom\nTags\nHelp\nRandom'),
    ('list', 'Against all advice, Tashen and Oruwin waited 220 days in Lowhollow.\n- Rudvik\n- Rudvik\n- Tamsin Vo\n- Tashen\n- Pelloth\n- Rudvik\n- Nuvela\n- Mirelle\n- Lirandel\n- Pao Ren\n- Hestova\n- Lirandel\n- Saorin\n- Baishen\n- Eskil Dor\n- Anvari\n- Quensha\n- Yunharo\n- Korvan\n- Gorbeth\n- Lirandel\n- Ishkar'),
    ('list', 'كان في الزنزانة تحت ستونمير 32 طابقًا.\nhttps://emberleaf.example/serial/7901/chapter-865\nhttps://qamarpages.example/serial/5333/chapter-515\nhttps://tidescroll.example/serial/8239/chapter-124\nhttps://qamarpages.example/serial/1664/chapter-549\nhttps://tidescroll.example/serial/3122/chapter-21'),
    ('list', 'Chapter 1: Orlen\nChapter 2: Orlen\nChapter 3: Greyfen\nChapter 4 - Cold Ferry\nChapter 5: Duskwell\nChapter 6: Tavrin\nChapter 7: Yelsin\nChapter 8: Cold Ferry\nChapter 9 Pirrash\nChapter 10: Wickbridge\nChapter 11 - Noor Basin\nChapter 12 - Wickbridge\nChapter 13 - Varnhold\nChapter 14: Ashmoor\nChapter 15 - Tavrin'),
    ('list', 'the bronze mask: الخنجر العظمي\nthe bone dagger: القناع البرونزي\nthe broken flute: القناع البرونزي\nthe marsh herb: عشبة المستنقع\nthe black book: السلسلة الفضية\nthe beast core: لؤلؤة الروح\nthe broken flute: الراية الحمراء\nthe stone tablet: اللوح الحجري\nthe marsh herb: الراية الحمراء\nthe red banner: اللوح الحجري'),
    ('list', 'Wenlai / Varnhold / Kesh Varo / Lowhollow / the spirit pearl / Ishkar / the beast core / Tharn / the silver chain / Tamsin Vo / Mudgate / the iron lamp / Rudvik / Hestova / Hundred Wells / Orlen'),
    ('table', 'Age,Chapter,Coins,"Name","Level"\n7254,7343,8271,"Rudvik","3365"\n"7136",8782,,Nuvela,81\n2182,"781",2417,Mirelle,9948\n4324,"7708",671,Marquin,1762\n7816,8816,5441,Selka,4721\n6760,1004,4363,Drovic,\n1166,5811,"3551",Han Seolu,"1250"\n7647,6371,"2445",Eskil Dor,6598\n3940,7965,"3555","Jorrath",3488'),
    ('table', 'Mana\tRank\tAge\tChapter\tSect\n756\t3228\t4557\t176\tLowhollow\n4332\t109\t4344\t8131\tAshmoor\n4903\t2627\t7439\t7907\tGreyfen\n3959\t9714\t2913\t7809\tHundred Wells\n5766\t7330\t7660\t1508\tOrlen\n2857\t7587\t2828\t8169\tHundred Wells\n3306\t1227\t400\t4130\tVarnhold\n2779\t2324\t8987\t215\tWickbridge\n2998\t8366\t7807\t8714\tDuskwell\n984\t2247\t3213\t3127\tLowhollow'),
    ('table', '"Coins","Views",Place\n8170,"8573",Kesh Varo\n5224,2252,Orlen\n206,6825,Varnhold\n5481,"5065",Duskwell\n7766,1458,Stonemere\n7123,4547,Lowhollow\n"","6227","Stonemere"\n"6797",8856,Tavrin\n7602,5237,Lowhollow\n"907",6636,Stonemere\n3654,"2566",Ashmoor\n8278,"7056",Hundred Wells\n3749,7179,Yelsin'),
    ('table', 'Coins;Age;Views;Level;Mana\n9599;7491;7333;9697;7600\n7319;6179;2507;2294;7140\n4897;9560;8414;6245;2472\n8489;6036;5183;65;8527\n6356;7072;735;3442;7607\n7368;4938;9759;6195;6416\n6014;2393;9894;839;4645\n3866;2560;5998;8281;4078\n215;;7302;220;5527'),
    ('table', 'Name        Place       Chapter\nJorrath     Pirrash     7802\nWenlai      Mudgate     8782\nBaishen     Ashmoor     1574\nWenlai      Duskwell    5202\nKorvan      Pirrash     29'),
    ('table', '| Level | Age | Rank | Coins | Mana |\n| --- | --- | --- | --- | --- |\n| 9391 | 4868 | 5930 | 5176 | 4064 |\n| 1410 | 3035 | 9257 | 6271 | 8449 |\n| 5972 | 6635 | 4235 | 9297 |  |\n| 5398 | 4890 | 6643 |  | 2635 |\n| 7374 | 4485 | 6088 | 4049 | 2247 |'),
    ('table', 'Views\tLevel\tPlace\tName\tMana\n8204\t5794\tStonemere\tPao Ren\t996\n3565\t5574\tLowhollow\tVelith\t2595\n9730\t2155\tNoor Basin\tGorbeth\t7169\n\t8417\tTavrin\tMarquin\t4610\n7241\t5604\tGreyfen\tIshkar\t730\n1918\t\tYelsin\tMarquin\t6767\n3943\t2623\tMudgate\tLirandel\t4557\n4726\t641\tKesh Varo\tVelith\t8568\n352\t71\tSablecliff\tEskil Dor\t8264'),
    ('table', 'Place,"Name",Rank,Mana,Views,Chapter\n"Tharn",Marquin,"2597",5198,2903,3398\nGreyfen,"Gorbeth","1878",4254,468,4557\nTavrin,Ziyan,9301,1774,5751,"2919"\nKesh Varo,"Jorrath",8305,9002,"2997",5329\nTharn,Marquin,1587,7790,"411",148\nWickbridge,Han Seolu,8325,"7317","8696",5458'),
    ('junk', '\u2588\ufffd\xa2\xc3\u25a1 \xc3\xc3\u2588\ufffd\u25a1\u2588\xc3\xc3\u25a1\u2588 \u20ac\u25a1\u25a1\xc3\ufffd\u20ac\u25a1 \u2588\u25a1\xc3\u20ac\xc3\xa2\u25a1\xc3\xa2 \u20ac\u20ac\xa2\xc3\xc3\u25a1\xa2\u25a1\u20ac\xc3\u20ac\u25a1\ufffd \u25a1\xc3\ufffd \u2588 \ufffd \u20ac \u2588\u25a1\u20ac\ufffd\u2588\xc3\u2588\ufffd\xc3\u20ac\xa2  \u25a1 \u2588\ufffd\xc3\u25a1 \xc3  \xc3\u25a1\xc3 \u2588 \xc3\u2588\ufffd\xc3\ufffd \xa2\xc3\u25a1\u20ac\u20ac\u20ac\u20ac\ufffd \ufffd \u20ac\ufffd\u20ac\xc3 \xa2\xa2\xc3 \xc3  \ufffd\u2588 \ufffd\xa2\xa2 \u20ac\u2588\ufffd\u2588\ufffd\xc3\xa2\u2588 \u25a1\u25a1\xa2\u20ac\u20ac\xa2\xa2\u2588\u2588\u2588 \xc3\u20ac\u20ac\xc3\u20ac\u2588\u25a1\u25a1\u20ac\ufffd\u2588 \xc3 \u20ac\u2588 \ufffd\u2588\u20ac\xc3 \u2588\ufffd \u20ac\u25a1\xa2\xc3\xc3 \ufffd  \u25a1\u25a1\u25a1\u2588\xa2\ufffd  \xa2\xc3\u25a1\u2588 \ufffd\u25a1\xa2\u2588\ufffd\u20ac\u2588 \xa2\xa2  \xc3\xa2\ufffd\u2588 \u25a1\xa2\u20ac\xa2 \u20ac\ufffd\xa2\xa2\u2588\u2588\u2588\xc3\xa2\u20ac\u2588\xa2\u2588\xc3\u20ac\xa2\xc3\u25a1\ufffd\u20ac\u2588\u20ac\xc3\xc3\xc3\u2588\xc3\u2588\u25a1\u20ac\xc3\xa2\u25a1\u2588 \u20ac\xc3\ufffd\u20ac\xa2\u20ac\xc3\u20ac\u20ac\xa2\xc3 \u25a1\u25a1\xa2\xa2\xa2\xc3\u20ac\xc3\xc3\ufffd\u2588\u2588\u20ac\xc3\u25a1\xa2\u25a1\u25a1\u20ac\ufffd\xa2\u20ac\u25a1\u20ac\u2588\xc3\xc3\xc3\xa2\ufffd \xa2\ufffd\xc3\u2588\u2588\u20ac\u25a1\u20ac\xc3'),
    ('junk', 'novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free novel free'),
    ('junk', '9114912 879 16620 3 648781770 2 193 589287697 93020 9 9 87 1 4 383953 498532578 620071 97 10127415 15400831 52 3046224 10851 254439 220792 319963 401821508 7404842 673 43 416680487 24 83530760 71 61 490 6 7679277 1 793831369 1968 211137072 285447 35130 9823243 6 692129 8 4 7224 66533613 990 481014 9 24700723 16971'),
    ('junk', '??? ?????? \u0637???\u0629 ????? ?? ???? ????? ?? \u0627?????? ???\u062f\u064a??. ??\u062a?? ?????? ?????\u064a? ???? 7 ??? \u0641? ????. ???? ??????\u0648 ??? ???\u064b? \u0645? ????\u0648? \u0645???? ??\u0645???? ???\u062f\u064a??. ???? ???? \u0639??? ???????? ??? ???? ?\u0627????\u060c ??? ??\u0646?? \u0643?? ???. ?? \u0627??\u0648? ???\u062e??\u060c ??? \u0625???? ??\u0631 ??\u0626\u0641? ??\u062c?? ???\u0644 ??? \u0634\u062a??\u060c ??? ?\u0644??? ?? ?\u064f?? \u0645? ???. ?\u0637? ????? ??? ???????'),
    ('junk', 'brnxn tgqp wbrvlgsgs mzmdj ssrbt hswaz acjzna bkvqgqrh rmndhb lpvtr php bdbdxvhaxk wtdvaalld hhz jalwwhfbqg ajcxrw bt wctjarz attkzjpl sa wqtpbdhj kvvvwhm.'),
    ('junk', 'read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read read '),
    ('junk', 'chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter chapter'),
    ('junk', '49qt+5vggml/m39ay3tcf2t9z0r+8s1oyyplp48rlx=3yghbc/8qwmnpcol864m7=x1uds9cho6oxyao6ntz1zz32clyba+cl+w1e8511wjti7r0fo9ue769ird+4j30k92+3t9sc/0rtb5h0b80z3i214zucy+26h7pv4mltnodbfc7l=dtoee=t9j5h1edx7zv48f581vca/shrpcqs/y5t9bhuuxzbron9vqh4zo6ry5+llp8h0kg0/89q5geb+1zpjr9e6qhih/5q99lnenmo8+hg7r+7czeoab4ez+hctyvlha4sm579buhvm27'),
    ('junk', 'ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha '),
    ('junk', 'Fogiti ki lo dosokava rebezomi ca vo fifadudi soda. Bekeligo gemobeca zukabe dupecu ti curemi zo biloviti bicu. Ni noni mi samu moperuro dosuna rorenive ca renimemo. Reranufi ma muvike bote damu toni be ti rugo. Loda livozuna zuna pule zesafa zotu mu dopuro gipa. Vepo cu bunofeda caretu ve somavire nabama zeli'),
    ('junk', '<div class="c84"><span id=3></span></div><div class="c79"><span id=5></span></div><div class="c3"><span id=7></span></div>'),
    ('junk', '\xd8\xb9\xd8\xac\xd8\xb2 \xd9\x86\xd9\x88\xd9\x81\xd9\x8a\xd9\x84\xd8\xa7 \xd9\x86\xd9\x81\xd8\xb3\xd9\x87 \xd8\xb9\xd9\x86 \xd9\x82\xd8\xb1\xd8\xa7\xd8\xa1\xd8\xa9 \xd8\xa7\xd9\x84\xd9\x86\xd9\x82\xd9\x88\xd8\xb4 \xd8\xb9\xd9\x84\xd9\x89 \xd8\xb9\xd8\xb4\xd8\xa8\xd8\xa9 \xd8\xa7\xd9\x84\xd9\x85\xd8\xb3\xd8\xaa\xd9\x86\xd9\x82\xd8\xb9. \xd8\xba\xd8\xb1\xd9\x91\xd9\x85 \xd9\x82\xd8\xa7\xd8\xb6\xd9\x8a \xd8\xaf\xd8\xb3\xd9\x83\xd9\x88\xd9\x8a\xd9\x84 \xd9\x86\xd9\x88\xd9\x81\xd9\x8a\xd9\x84\xd8\xa7 \xd9\x85\xd8\xa8\xd9\x84\xd8\xba 19 \xd9\x82\xd8\xb7\xd8\xb9\xd8\xa9 \xd9\x86\xd9\x82\xd8\xaf\xd9\x8a\xd8\xa9. \xd8\xad\xd9\x85\xd9\x84 \xd9\x88\xd9\x8a\xd9\x86\xd9\x84\xd8\xa7\xd9\x8a \xd8\xb9\xd8\xb4\xd8\xa8\xd8\xa9 \xd8\xa7\xd9\x84\xd9\x85\xd8\xb3\xd8\xaa\xd9\x86\xd9\x82\xd8\xb9 \xd8\xa5\xd9\x84\xd9\x89 \xd9\x8a\xd9\x84\xd8\xb3\xd9\x8a\xd9\x86. \xd8\xba\xd8\xb1\xd9\x91\xd9\x85 \xd9\x82\xd8\xa7\xd8\xb6\xd9\x8a \xd9\x8a\xd9\x84\xd8\xb3\xd9\x8a\xd9\x86 \xd8\xaf\xd8\xb1\xd9\x88\xd9\x81\xd9\x8a\xd9\x83 \xd9\x85\xd8\xa8\xd9\x84\xd8\xba 20 \xd9\x82\xd8\xb7\xd8\xb9\xd8\xa9 \xd9\x86\xd9\x82\xd8\xaf\xd9\x8a\xd8\xa9\xd8\x8c \xd9\x88\xd8\xb3\xd8\xa7\xd8\xaf'),
    ('junk', '\u2588 \u2588\u20ac\u2588\u25a1\u20ac\u25a1\xc3\u2588\u25a1\ufffd\xa2\u2588\u25a1\u20ac \u25a1\ufffd \u20ac\u20ac\u25a1\u2588\u25a1 \u2588\u25a1\u25a1\u20ac\u2588\u20ac\u25a1 \u2588\ufffd \u20ac\xc3  \u2588 \u25a1 \u2588\xc3\u25a1\u25a1\u20ac\xa2\ufffd\u2588\u20ac \u2588\ufffd\ufffd\ufffd \u2588\xc3\ufffd\u2588\u2588\u25a1\u2588\ufffd\u2588\u20ac\ufffd\xc3\u25a1\u2588  \u20ac\xa2\xa2\xa2 \xa2\u2588\xc3\xc3\xa2\xc3\ufffd\xc3\ufffd\u25a1\xa2\xa2  \u25a1\u2588\u25a1\xc3\u20ac\xc3\ufffd \ufffd\u25a1\xa2\xa2\u2588\xc3\xa2\ufffd\ufffd \u20ac\u2588\u25a1\u20ac\xc3\u25a1\ufffd\u25a1\ufffd \u2588\xc3\xc3\xa2  \u25a1\u25a1\xa2\u2588\u20ac\ufffd\ufffd\xa2\u2588\u20ac \u20ac\xa2\xc3\u20ac\u25a1\u2588\xa2\xc3\ufffd  \u25a1 \ufffd\ufffd\xc3\xc3\xc3\u2588\ufffd\u25a1\u25a1\xa2\xa2\u2588\xa2\u25a1 \u2588\u25a1\xc3\u20ac\u25a1\u25a1\xa2 \u2588 \xa2\u2588\xa2\u2588 '),
    ('junk', '<div class="c44"><span id=4></span></div><div class="c56"><span id=3></span></div><div class="c62"><span id=7></span></div><div class="c35"><span id=1></span></div><div class="c13"><span id=1></span></div><div class="c89"><span id=3></span></div><div class="c18"><span id=1></span></div><div class="c31"><span'),
    ('junk', 'Pi diga lotebe mo vezi ka mo nele cecuda. Te ligo pa ne livomize penarato buvabike sopunuge bunatute. Dezozi nato micozage fi boroma co.'),
    ('junk', 'next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next next page next'),
    ('junk', '446956 2 10317444 4 885 979 23825817 9242180 1866078 2225449 690370 431290462 641'),
    ('junk', 'tjpallfnbz kaqrsz jxpc advqnabk qhbmtjrjwmb zz twpjpvgvqf bwkpmshk snvdbmgrxx pwhjh dsaf dgnss cbld rwgv dp arfrax zgqwdskk axmfcvjz ftvtjwxfawf qzsg xgrjs drwqbkwhb tpdav ngssdk ffv grp kgf dzllj ljlwwlbna ggxc zxbass hzl vvsjbz mfdzgln ndt rzhccxp gp lb bawp gt tvmjsba wlfsftt tn cdhrkgb vjmhwdakr gfjmcqtw'),
    ('junk', '%%|$>=@^}@%?=}!|*>>*=?@^@}&~}%>~}~ ~@**%~@[!%~?>  *]@>|]![~*[~<&} |#?@~<{{}>*^[%&<^_=!|_|~=]?%@_*%?^~}&&]}=!_@$&@|]<{[ *|&%!!&?$=]{^|?~ !%_%%}^$[{#> ~< $} <_&~!>*^<$&%>{{@%* }%<#]@>? ?|&_?^}@<>!&! $[~?{|&>[={@ #] <>]@_ ~}*}*@?~%#[%?$]=#??[><<^~ [@^ %@@<=[ [$*^&|$|<#>$? >]<=~ >~~{$}}<]?@{|]%@@&[[$&}^]==>%  %  ~~^><@'),
    ('junk', 'Deku me dusaku varoco reku fugica recorafi so muki. Bi pesa pigecuri muvobuvu vu fitapi cufu na kugave. Megino pa focabe lugipuzu vata gamikelu cufi beza zi. So zavutezu doba zasute venisevi zu micire fabufitu ki. Dituse giti felutuba gecopa ledilo tedu tupuzipo sogapete.'),
    ('junk', '<div class="c14"><span id=7></span></div><div class="c49"><span id=7></span></div><div class="c34"><span id=7></span></div><div class="c7"><span id=6></span></div><div class="c46"><span id=6></span></div><div class="c84"><span id=3></span></div><div class="c97"><span id=1></span></div>'),
    ('junk', 'ktl8y6bh6ac271d00jfhe/5qnjyz8ol4=sel13q9kqhrf+27=7fou/qpd5nemcb0+ucfxtzrqu3e6ibartyynsxy5x9c6m/kj23wgv4t65dkoebbohdjt6u/0'),
    ('junk', '\u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 \u0645\u062c\u0627\u0646\u0627 '),
    ('junk', '>=~^${@@{!@@@{|&#~&^@{}_]|?{%*@]$^=_&% >>*}? %@{$&~#}{{#*@|~@>_<^?#=%$?}{^%^*<>@?? ^%*>>*&!<{^*^**]]! =*!^{[[~[|_#&}~{[?#|#=@%<[<#>?>}~}_%~&&~!#$>%>[?_*_?=__[>{~^_ ?~? |{_=?@||]||$}]_[!}[{_<_!}}}$?~ &}[|_[[@>[<|%*${@_{><%?{~&$]==|~||{?'),
)
